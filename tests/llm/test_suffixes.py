"""Suffix-array dedup against a plain version: its arrays, and its results on small and odd tables with every step in use."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sortarium.llm import suffixes


def made(rng, n, letters=b"ab\x00c"):
    out = bytearray()
    while len(out) < n:
        out += bytes(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        if len(out) > 4:
            at = rng.randrange(len(out))
            out += out[at : at + rng.randint(1, 40)] * rng.choice([1, 1, 3])
    return bytes(out[:n])


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 7, 8, 9, 30, 200, 700] * 6:
        raw = made(rng, n) if n % 3 else bytes(n)
        x = np.frombuffer(raw, np.uint8)
        sa = suffixes.suffix_array(x)
        assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
        for depth in (5, 16, 100):
            lcp = suffixes.common_prefixes(x, sa, depth, lanes=rng.choice([1, 3, 4096]))
            want = [next((k for k in range(n) if k == depth or max(i, j) + k == n or raw[i + k] != raw[j + k]), 0) for j, i in zip(sa[:-1].tolist(), sa[1:].tolist())]
            assert lcp.tolist() == ([0] if n else []) + want


def plain(rows, length):
    """By looking every string up among the strings before it, over rows without copies, in the order of their ids and texts."""
    seen, out = set(), {}
    for i, raw in rows:
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(raw[k : k + length])
        edges = np.flatnonzero(np.diff(np.append(False, gone).astype(int)))
        out[i, raw] = ([tuple(map(int, e)) for e in edges.reshape(-1, 2)], bytes(b for b, g in zip(raw, gone) if not g))
    return out


@pytest.mark.parametrize("want", [suffixes.Settings(8, 3, shard_bytes=900, portion=500), suffixes.Settings(12, 5, shard_bytes=100_000, portion=100_000), suffixes.Settings(9, 9, shard_bytes=400, hot=2, portion=1), suffixes.Settings(1, 1, shard_bytes=3000)], ids=repr)
def test_equals_a_plain_version(spark, want):
    rng = random.Random(want.length)
    shared = [made(rng, 60, b"abcdefgh").decode() for _ in range(6)]
    texts = ["".join(rng.choice([*shared, made(rng, rng.randint(1, 50), b"abcdefghij").decode()])[rng.randint(0, 20) :] for _ in range(rng.randint(0, 6))) for _ in range(120)]
    texts += [*texts[:20], "", None, "é語" * 30, "語é" * 30, "aaaaaaaaa" * 40, "x" * want.length, "x" * (want.length - 1), "yz" * want.length]
    ids = rng.sample(range(-50, 10_000), len(texts))
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("id", F.lit("theirs")).repartition(3)
    work = suffixes.Work(spark)
    got = suffixes.deduplicated(docs, work, want).collect()
    work.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("shards_")]
    expected = plain(sorted((i, (t or "").encode()) for i, t in rows), want.length)
    assert len(got) == len(rows) + 2
    text_of = dict(rows)
    for r in got:
        raw = (text_of[r.doc_id] or "").encode()
        assert (r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) == (len(raw), *expected[r.doc_id, raw]), r.doc_id


def test_repeated_and_null_ids(spark):
    want = suffixes.Settings(10, 4)
    rows = [(None, "first of all, words"), (1, "words and first of all"), (1, "other of one id, words and"), (2, "first of all, words"), (None, "first of all, words")]
    work = suffixes.Work(spark)
    got = suffixes.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), work, want).collect()
    empty = suffixes.deduplicated(spark.createDataFrame([], "doc_id long, text string"), work, want).count()
    work.close()
    kept = sorted((repr(r.doc_id), bytes(r.kept).decode()) for r in got)
    assert empty == 0 and [k for k in kept if k[0] == "None"] == [("None", "first of all, words")] * 2 and ("2", "") in kept
    of_one = {len(k) for i, k in kept if i == "1"}
    # of the two texts of one id either is the earlier; "words and" is too short to repeat, " words and " is not there twice
    assert of_one == {len("words and "), len("other of one id, words and")}


def test_equal_hashes_of_unequal_strings_are_told_apart(monkeypatch):
    monkeypatch.setattr(suffixes, "mix", lambda x: x & np.uint64(0))
    pieces = pa.Table.from_arrays([pa.array([1, 1, 1]), pa.array([5, 6, 7]), pa.array([0, 0, 0]), pa.array([0, 10, 20]), pa.array([12, 22, 32]), pa.array([b"abcdefghijkl", b"zbcdefghijkl", b"abcdefghijkz"])], schema=suffixes.PIECE)
    got = suffixes.merged(pieces, suffixes.Settings(10, 4)).to_pylist()
    assert got == [{"id": 6, "tie": 0, "start": 11, "stop": 22}, {"id": 7, "tie": 0, "start": 20, "stop": 31}]


def test_query_on_long_texts(spark):
    rng = random.Random(9)
    a, b = (" ".join(rng.choice(["river", "stone", "walk", "ügly", "語"]) + str(rng.randrange(999)) for _ in range(400)) for _ in range(2))
    rows = [(1, a), (2, a), (3, b + a[500:900] + b), (4, a[:99]), (5, b[:300]), (6, None)]
    out = {r.doc_id: r for r in suffixes.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = plain([(i, (t or "").encode()) for i, t in rows], 100)
    for i, t in rows:
        raw = (t or "").encode()
        spans, kept = expected[i, raw]
        assert tuple(out[i]) == (i, len(raw), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept).hexdigest())
