"""Runs of words and filling in the middle, against plain versions of their definitions and on odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sortarium.llm import fim, periodic

ODD = ["", None, " \n ", "a", "a b " * 9, "a b " * 9, "x " * 30_000, "q" * 70_000, "<P>", "é𝄞\n<語> " * 40, "one two three " * 2]


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def plain_runs(s, want=periodic.Settings()):
    """Every stretch that keeps a period, by trying all periods; of equal stretches the least period."""
    out = {}
    for q in range(1, len(s) // want.exponent + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(want.exponent * q, want.least):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    out, kinds = [], rng.choice([1, 2, 2, 3, 5, 30])
    while len(out) < rng.randint(0, 120):
        out += [rng.randrange(kinds) for _ in range(rng.randint(1, 6))] * rng.choice([1, 1, 2, 4, 5, 7])
        if rng.random() < 0.3 and out:
            at = rng.randrange(len(out))
            out += out[at : at + rng.randint(1, 40)]
    return out


def test_runs_equal_plain_ones_with_and_without_the_prefilter():
    rng = random.Random(1)
    for _ in range(1200):
        s, want = some_words(rng), rng.choice([periodic.Settings(), periodic.Settings(2, 2), periodic.Settings(3, 4), periodic.Settings(2, 5), periodic.Settings(4, 2)])
        assert periodic.runs_of(s, want) == plain_runs(s, want)
        words = [str(c).encode() for c in s]
        assert periodic.runs_in(words, periodic._possible([words, [], words], want)[2], want) == plain_runs(s, want)


def test_factors_are_the_longest_earlier_prefixes():
    rng = random.Random(2)
    for _ in range(300):
        s = some_words(rng)
        at = 0
        for start, length, source in periodic.factors(s):
            assert start == at
            longest = max((k for b in range(start) for k in range(len(s) - start + 1) if s[b : b + k] == s[start : start + k]), default=0) if len(s) < 60 else length
            assert length == max(1, longest) or len(s) >= 60
            assert source < 0 or source < start and s[source : source + length] == s[start : start + length]
            at += length
        assert at == len(s)


def test_settings_are_refused():
    for bad in ((1, 6), (4, 1)):
        with pytest.raises(ValueError):
            periodic.Settings(*bad)
    for bad in ({"prefix": "é"}, {"suffix": "<P>"}, {"prefix": "ab", "suffix": "bc"}, {"unit": "word"}, {"middle": "P"}):
        with pytest.raises(ValueError):
            fim.Settings(**bad)


def plain_periodic(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha(lines.encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_query_equals_a_plain_version(spark):
    rng = random.Random(3)
    texts = [*(t for t in ODD if t is None or len(t) < 5000), *(" ".join(map(str, some_words(rng))) for _ in range(150))]
    rows = [*enumerate(texts), (None, "a " * 12), (3, "b c " * 8), (3, "b c " * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("periodic", F.lit("theirs")).withColumn("runs", F.lit(1))
    got = [tuple(r) for r in periodic.digests(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr((k, *plain_periodic(k, t))) for k, t in rows)
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows)
    assert periodic.digests(docs.limit(0)).count() == 0


def test_periodic_results_on_odd_rows(spark):
    docs = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(ODD)], "doc_id long, text string, runs string")
    out = {r.doc_id: r for r in periodic.scanned(docs).collect()}
    assert all(r.runs == "kept" for r in out.values())
    assert [tuple(x) for x in out[4].periodic.runs] == [(0, 18, 2)] and out[4].periodic == out[5].periodic and out[4].periodic.collapsed == "a b"
    assert out[6].periodic.collapsed == "x" and [tuple(x) for x in out[6].periodic.runs] == [(0, 30_000, 1)]
    assert out[0].periodic.n_words == out[1].periodic.n_words == 0 and out[1].periodic.collapsed == "" and out[10].periodic.runs == []


def test_automaton_counts_and_cuts_as_strings_do():
    rng = random.Random(4)
    marks = ("<P>", "<S>", "<M>")
    small = fim.Scanner(marks, "char")
    small.piece = 256
    for s, lines in ((fim.scanner(marks, "char"), False), (small, False), (fim.scanner(marks, "line"), True)):
        for _ in range(60):
            texts = ["".join(rng.choice("ab<PSM>\né𝄞語<") for _ in range(rng.randint(0, rng.choice([5, 300, 1500])))) for _ in range(rng.randint(1, 12))]
            counted = fim.Counted([t.encode() for t in texts], s)
            for k, t in enumerate(texts):
                units = re.findall(r"[^\n]*\n|[^\n]+", t) if lines else list(t)
                assert counted.units[k] == len(units) and counted.sentinels[k] == len(re.findall("<[PSM]>", t))
                for n in (0, len(units), rng.randint(0, len(units))):
                    assert counted.cut(k, n) == len("".join(units[:n]).encode())


def plain_fim(doc_id, text):
    t = text or ""
    d = sha(f"1:{doc_id}".encode())
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if doc_id is None or not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return (len(t), "plain", None, None, sha(t.encode()), sha(t.encode()))
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    spm = h[3] % 100 < 20
    out = f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" if spm else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
    return (len(t), "spm" if spm else "psm", a, b - a, sha(out.encode()), sha(t.encode()))


def test_fim_query_equals_a_plain_version(spark):
    rng = random.Random(5)
    texts = [*ODD, *("".join(rng.choice("<<PSM>> é\n語𝄞") for _ in range(rng.randint(1, 60))) for _ in range(200))]
    rows = [*enumerate(texts), (None, "no key"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fim", F.lit("theirs")).withColumn("output", F.lit(1))
    got = [tuple(r) for r in fim.digests(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr((k, *plain_fim(k, t))) for k, t in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.digests(docs.limit(0)).count() == 0


def test_fim_by_lines_cuts_between_lines_and_restores(spark):
    want = fim.Settings("[pre]", "[suf]", "[mid]", rate=100, suffix_first=50, seed=7, unit="line")
    docs = spark.createDataFrame([(k, "".join(f"line {i}\n" for i in range(k))) for k in range(40)], "doc_id long, text string").withColumn("output", F.lit("theirs"))
    rows = fim.transformed(docs, want).withColumn("again", fim.restored(F.col("fim.output"), F.col("fim.form"), want)).collect()
    assert all(r.again == r.text and r.output == "theirs" and r.fim.units == r.doc_id for r in rows)
    assert {r.fim.form for r in rows if r.doc_id} == {"psm", "spm"}
    assert all(r.fim.output.split("[mid]")[1] == "".join(f"line {i}\n" for i in range(r.fim.prefix_units, r.fim.prefix_units + r.fim.middle_units)) for r in rows if r.doc_id)
