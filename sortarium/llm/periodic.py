"""Runs of words: maximal stretches that repeat with a period, found by Kolpakov and Kucherov's algorithm.

A text's words are its stretches without ASCII white space. A run is a stretch of words with least period q (words
q apart are equal) and at least `exponent` * q and `least` words that no neighbouring word extends keeping q.

1. Words that can't be in a run go first: every gram of `_gram` words inside a run occurs twice in it, so words in no
   repeated gram of their text are in no run, and no run extends over them. What is left stays in order, with separators.
2. A suffix automaton with the first end of every state gives the LZ factors: the longest prefix of the rest
   that began before, or a new word.
3. Main's algorithm finds the runs that touch the border of two factors from four Z-functions of the words around it.
4. A run inside a factor has been found where the factor's words occurred before, and is copied from there.

All four are linear in the words; a task holds one slice of texts, and the automaton of one text at a time.

Null and empty texts have no words and no runs. Repeated rows get equal results, an empty table an empty one. Of the
caller's columns only one named like the added column is replaced; all others pass through unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortarium.llm.common import mix, slices, tidied


@dataclass(frozen=True)
class Settings:
    """The least words of a run and of its periods in it."""

    exponent: int = 4
    least: int = 6

    def __post_init__(self):
        if self.exponent < 2 or self.least < 2:
            raise ValueError("a run has at least two periods and two words")


FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _z(s: list[int]) -> list[int]:
    """For every place the length of the longest prefix of s that also begins there."""
    n = len(s)
    out, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        out[i] = k
    return out


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """The LZ factors of s as (start, length, start of an earlier occurrence or -1 for a new symbol)."""
    steps: list[dict[int, int]] = [{}]
    link, length, first, last = [-1], [0], [-1], 0
    for i, c in enumerate(s):
        new = len(steps)
        steps.append({})
        link.append(0)
        length.append(i + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(steps[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                link[q] = link[new] = copy
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
        last = new
    out, at, n = [], 0, len(s)
    while at < n:
        state, end = 0, at
        while end < n and first[q := steps[state][s[end]]] < end:
            state, end = q, end + 1
        out.append((at, end - at, first[state] - (end - at) + 1) if end > at else (at, 1, -1))
        at = max(end, at + 1)
    return out


def _touching(s: list[int], x: int, before: int, after: int, want: Settings, found: dict[tuple[int, int], int]) -> None:
    """Runs that touch the border at x of factors of `before` and `after` words and end by the second one's end.

    One that reaches back over the first factor by a whole period would have made that factor longer, so periods
    and the words to look at are bounded by the two lengths.
    """
    most = (before + after - 1) // (want.exponent - 1)
    if most < 1:
        return
    low, end, n = max(0, x - before - most), x + after, len(s)
    u, v = s[low:x], s[x:end]
    back = u[::-1]
    right, left = min(most, len(v)), min(most, len(u))
    ahead_v, back_u = _z(v), _z(back)
    back_v = _z(back + [-1] + v[:right][::-1] + back)  # -1 is no symbol: words count from 0, separators from -2 down
    ahead_u = _z(v + [-1] + u[len(u) - left :] + v)

    def keep(start: int, stop: int, q: int) -> None:
        if stop - start < max(want.exponent * q, want.least) or low and start == low or end < n and stop == end and s[end] == s[end - q]:
            return
        if found.get((start, stop), q) >= q:
            found[start, stop] = q

    for q in range(1, right + 1):
        ahead = ahead_v[q] if q < len(v) else 0
        behind = back_v[len(u) + 1 + right - q]
        if ahead + behind >= (want.exponent - 1) * q:
            keep(x - behind, x + q + ahead, q)
    for q in range(1, left + 1):
        behind = back_u[q] if q < len(u) else 0
        ahead = ahead_u[len(v) + 1 + left - q]
        if ahead + behind >= (want.exponent - 1) * q:
            keep(x - q - behind, x + ahead, q)


def runs_of(s: list[int], want: Settings = Settings()) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of s by start, then period; separators are negative, each its own, from -2 down."""
    parts, found = factors(s), {}
    for (_, before, _), (x, after, _) in zip(parts, [*parts[1:], (len(s), 0, -1)]):
        _touching(s, x, before, after, want, found)
    by_start: dict[int, list[tuple[int, int]]] = {}
    for (start, stop), q in found.items():
        by_start.setdefault(start, []).append((stop, q))
    if by_start:
        for at, length, source in parts:
            if source >= 0:
                for k in range(1, length - 1):
                    for stop, q in by_start.get(source + k, ()):
                        if stop < source + length:
                            by_start.setdefault(at + k, []).append((stop + at - source, q))
    return sorted(((start, stop - start, q) for start, ends in by_start.items() for stop, q in ends), key=lambda r: (r[0], r[2]))


def _gram(want: Settings) -> int:
    """The most words for which a run's every gram begins twice in it, whatever its period."""
    return max(1, min(max(want.least, want.exponent * q) - 2 * q + 1 for q in range(1, want.least + 2)))


def _possible(words: list[list[bytes]], want: Settings) -> list[np.ndarray]:
    """For every text the places of its words that a gram covers which the text holds twice."""
    k = _gram(want)
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if total < k:
        return [np.zeros(0, np.int64) for _ in words]
    hashed = np.fromiter((hash(x) for w in words for x in w), np.int64, total).view(np.uint64)
    text = np.repeat(np.arange(len(words)), sizes)
    gram = mix(text.astype(np.uint64))[: total - k + 1].copy()
    for j in range(k):
        gram = mix(gram + hashed[j : total - k + 1 + j])
    whole = np.flatnonzero(text[: total - k + 1] == text[k - 1 :])
    order = np.sort(gram[whole])
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return [np.zeros(0, np.int64) for _ in words]
    hits = whole[twice[np.minimum(np.searchsorted(twice, gram[whole]), len(twice) - 1)] == gram[whole]]
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, hits, 1)
    np.add.at(change, hits + k, -1)
    places = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    bounds = np.searchsorted(places, np.append(0, ends))
    return [places[bounds[i] : bounds[i + 1]] - (ends[i] - sizes[i]) for i in range(len(words))]


def runs_in(words: list[bytes], places: np.ndarray, want: Settings = Settings()) -> list[tuple[int, int, int]]:
    """The runs of words, all of which lie in stretches of `places`."""
    if len(places) < want.least:
        return []
    names: dict[bytes, int] = {}
    s, origin, apart = [], [], -2
    for i in places.tolist():
        if origin and origin[-1] != i - 1:
            s.append(apart)
            origin.append(-1)
            apart -= 1
        s.append(names.setdefault(words[i], len(names)))
        origin.append(i)
    return [(origin[start], length, q) for start, length, q in runs_of(s, want)]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, q in runs:
            gone[start + q] += 1
            gone[start + length] -= 1
        stay = np.cumsum(gone[:-1]) == 0
        words = [w for w, s in zip(words, stay.tolist()) if s]
    return b" ".join(words).decode("utf-8", "replace")


def scanned(docs: DataFrame, want: Settings = Settings(), text: str = "text", into: str = "periodic", order: tuple[Column, Callable[[int, int], np.ndarray | None]] | None = None) -> DataFrame:
    """docs with a struct `into` of FOUND: the words, the runs by start and period, and the words that stay.

    A word stays unless a run holds it after that run's first period. order, a column of longs and a function of its
    value and the number of words, gives the places of the words to take instead of the text's own (None: as they are);
    a null value leaves the text alone.
    """
    column, places_of = order or (F.lit(None).cast("long"), lambda value, n: None)

    @tidied
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, values in batches:
            count, offsets, flat, kept = [], [0], [], []
            values = values.to_pylist()
            for part, some in slices(texts, 256):
                words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in some]
                for k, value in enumerate(values[part]):
                    if value is not None and words[k] and (places := places_of(value, len(words[k]))) is not None:
                        words[k] = [words[k][i] for i in places.tolist()]
                for w, places in zip(words, _possible(words, want)):
                    runs = runs_in(w, places, want)
                    count.append(len(w))
                    flat += runs
                    offsets.append(len(flat))
                    kept.append(_collapsed(w, runs))
            fields = np.array(flat, np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(fields[:, k]) for k in range(3)], names=["start", "length", "period"])
            yield pa.StructArray.from_arrays([pa.array(count, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items), pa.array(kept, pa.string())], names=["n_words", "runs", "collapsed"])

    def columns(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from run(batches)

    return docs.withColumn(into, F.arrow_udf(columns, FOUND)(F.col(text), column))


def repeated_tail(drawn: int, n: int) -> np.ndarray | None:
    """The query's planted runs: one text in ten has the words from a drawn place on replaced by the first of them, again and again."""
    if drawn % 10:
        return None
    g = drawn // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest one, and digests of all runs and of the words that stay."""
    found = scanned(docs.select("doc_id", "text"), order=(F.crc32(F.col("doc_id").cast("string").cast("binary")), repeated_tail))
    runs = F.col("periodic.runs")
    rows = found.select("doc_id", runs.alias("runs"), F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"))
    rows = rows.withColumn("best", F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256",
    )
