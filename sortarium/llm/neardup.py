"""Near-duplicate texts by BagMinHash signatures, banding and a check of the multiset overlap.

A text is the multiset of its runs of five words (a shorter text is one run of all its words), words
being lower-cased runs of letters and digits. Two texts are near duplicates if the sum of the smaller
multiplicities is at least 0.8 of the sum of the larger ones; classes are the connected components.

BagMinHash draws, for every element, points of Poisson processes over dyadic strata of its weight
([0,1), [1,2), [2,4), ...), each point falling on one level of its stratum and one place of the
signature; a place keeps the least point whose level the element's weight covers. Two signatures
agree at a place with probability equal to the weighted Jaccard similarity. Strata beyond an
element's weight are never opened and points beyond the largest place are never drawn.

Null texts count as empty. Texts without words are duplicates only of the same text. Rows that repeat
a doc_id are one document, whose classes are joined; each of its texts is compared with others. Rows
with a null doc_id take no part and have no class. An empty table has no classes. Long texts count
whole. Extra columns, whatever their names, pass through `deduplicated`; `classes` returns its own
columns only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortarium.llm.common import Scratch, cut, mix, portions, slices, small_side, stored, tidied, word_hashes
from sortarium.llm.graph import components


@dataclass(frozen=True)
class Settings:
    """bands * rows places; at 0.8 a pair shares a band with probability 1 - (1 - 0.8 ** rows) ** bands = 0.9999.

    Each bucket's most central text is held against the others, by whole multisets, and led buckets elect
    again among what is still in other classes for as long as at least a share `worth` of the checked pairs
    are links. After that, every pair of a bucket that is still in different classes is compared by the
    signatures (a byte a place) and, unless these agree in fewer places than six standard deviations below
    `similarity`, by whole multisets. `block` bounds the runs of words that one side of a comparison holds.
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 6
    worth: float = 0.125
    block: int = 100_000
    seed: int = 41

    @property
    def agreeing(self) -> int:
        """The places in which two near duplicates agree at least."""
        n = self.bands * self.rows
        return max(0, int(n * self.similarity - 6 * (n * self.similarity * (1 - self.similarity)) ** 0.5))


#: The fewest runs that a text counts as when blocks are made, so that a block has a bounded number of texts too.
_LEAST_RUNS = 200


def shingles(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, multiplicity, text's place) of every distinct run of words, sorted by place and hash."""
    h, doc, _ = word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    start = np.flatnonzero(np.arange(len(h)) - first[doc] <= np.maximum(n[doc] - words, 0))
    run = np.zeros(len(start), np.uint64)
    for k in range(words):
        at = start + k
        inside = np.minimum(at, len(h) - 1) if len(h) else at
        same = (at < len(h)) & (doc[inside] == doc[start])
        run = run * np.uint64(0x5851F42D4C957F2D) + np.where(same, mix(h[inside]), np.uint64(k))
    place, run = doc[start], mix(run)
    order = np.lexsort((run, place))
    place, run = place[order], run[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (place[1:] != place[:-1])
    at = np.flatnonzero(new)
    return run[at], np.diff(np.append(at, len(run))), place[at]


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from hashes."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def bag_minhash(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, owners: int, places: int, seed: int = 0) -> np.ndarray:
    """owners x places signature values (positions of points; infinite for owners without elements)."""
    least = np.full((owners, places), np.inf)
    flat = least.reshape(-1)
    has = np.bincount(owner, minlength=owners) > 0
    state, rate, low, doc, full = [], [], [], [], []
    stratum, at = 0, np.arange(len(element))
    while len(at):
        lo, hi = (0, 1) if stratum == 0 else (1 << (stratum - 1), 1 << stratum)
        at = at[weight[at] > lo]
        state.append(mix(element[at] ^ mix(np.full(len(at), stratum + (seed << 8), np.uint64))))
        rate.append(np.full(len(at), float(hi - lo)))
        low.append(np.full(len(at), lo))
        doc.append(owner[at])
        full.append(weight[at])
        stratum += 1
    if not state:
        return least
    state, rate, low, doc, weights = map(np.concatenate, (state, rate, low, doc, full))
    x = np.zeros(len(state))
    largest = np.full(owners, np.inf)
    turn = 0
    while len(state):
        state = mix(state)
        x = x - np.log(_unit(state)) / rate
        alive = x < largest[doc]
        if not alive.all():
            state, rate, low, doc, weights, x = (v[alive] for v in (state, rate, low, doc, weights, x))
        bits = mix(state ^ np.uint64(0xD1B54A32D192ED03))
        level = low + ((bits >> np.uint64(32)) * rate.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        slot = doc * places + ((bits & np.uint64(0xFFFFFFFF)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)
        hit = level < weights
        np.minimum.at(flat, slot[hit] if not hit.all() else slot, x[hit] if not hit.all() else x)
        turn += 1
        if turn < 4 or turn % 8 == 0:
            live = np.unique(doc)
            largest[live] = least[live].max(axis=1)
    assert not np.isinf(least[has]).any()
    return least


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """owners x bands hashes, of the signature's values in each band."""
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    h = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), bits.shape[:2]).copy()
    for k in range(rows):
        h = mix(h ^ bits[:, :, k])
    return h


def signed(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, print_a, print_b, n, bands, sketch) of every row: equal prints mean equal multisets (128 bits).

    bands are the keys of its buckets, sketch a byte of each place of the signature.
    """

    @tidied
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch.column("text"), 256):
                run, times, place = shingles(texts, s.words)
                n = np.bincount(place, times, len(texts)).astype(np.int64)
                a, b = prints_of((run, times, place), texts)
                least = bag_minhash(run, times, place, len(texts), s.bands * s.rows, s.seed)
                bands = band_hashes(least, s.bands, s.rows).view(np.int64)
                sketch = (mix(least.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)
                columns = [batch.column("doc_id").slice(part.start, len(texts)), pa.array(a), pa.array(b), pa.array(n)]
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * s.bands, pa.int32()), pa.array(bands.reshape(-1))))
                columns.append(pa.array([x.tobytes() for x in sketch], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print_a", "print_b", "n", "bands", "sketch"])

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, print_a long, print_b long, n long, bands array<long>, sketch binary")


def prints_of(runs: tuple[np.ndarray, np.ndarray, np.ndarray], texts: list[str | None]) -> list[np.ndarray]:
    """The two halves of each text's print, as signed longs, from its shingles(); a text without words is hashed itself."""
    run, times, place = runs
    prints = [np.zeros(len(texts), np.uint64) for _ in range(2)]
    for x, out in enumerate(prints):
        np.add.at(out, place, mix(run + np.uint64(x + 1)) * mix(times.astype(np.uint64)))
    for i in np.flatnonzero(np.bincount(place, minlength=len(texts)) == 0):
        h = xxhash.xxh128_intdigest((texts[i] or "").encode("utf-8", "surrogatepass"))
        prints[0][i], prints[1][i] = h >> 64, h & ((1 << 64) - 1)
    return [x.view(np.int64) for x in prints]


#: Rows up to which the (cell, rep) rows of a round are broadcast to the texts (about 16 MB).
_BROADCAST_MEMBERS = 400_000


def texts_of(docs: DataFrame, reps: DataFrame, several: DataFrame | None, repeats: bool, s: Settings) -> DataFrame:
    """(rep, text) of each of reps (rep, doc_id, print_a, print_b): of rows with equal prints the least text.

    several: the doc_ids that hold texts of different prints, or None; their rows are found by print, others by
    doc_id. repeats: whether rows repeat a doc_id.
    """

    @tidied
    def printed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = batch.text.tolist()
            for part in portions(whole, 256):
                a, b = prints_of(shingles(whole[part], s.words), whole[part])
                yield pd.DataFrame({"doc_id": batch.doc_id.iloc[part].to_numpy(), "text": whole[part], "print_a": a, "print_b": b})

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if several is None:
        found = docs.join(small_side(reps.select("doc_id", "rep")), "doc_id").select("rep", "text")
        return found.groupBy("rep").agg(F.min("text").alias("text")) if repeats else found
    rows = docs.join(small_side(reps.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = rows.mapInPandas(printed, "doc_id long, text string, print_a long, print_b long")
    return rows.join(reps, ["doc_id", "print_a", "print_b"]).groupBy("rep").agg(F.min("text").alias("text"))


CELL = ["tag", "low", "high"]


def by_cell(rows: DataFrame, then: list[str], work, out: str) -> DataFrame:
    """work(rows) -> columns for the rows (arrays by name) of every cell, in order of `then`; a task holds a cell at a time."""
    names = rows.columns

    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, np.ndarray]] = []

        def done(part: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            whole = [*held, part]
            held.clear()
            return work(part if len(whole) == 1 else {c: np.concatenate([w[c] for w in whole]) for c in names})

        for batch in batches:
            if not len(batch):
                continue
            cols = {c: batch[c].to_numpy() for c in names}
            keys = np.stack([cols[c].astype(np.int64) for c in CELL], axis=1)
            found = []
            if held and any(held[0][c][0] != cols[c][0] for c in CELL):
                found.append(done({c: v[:0] for c, v in cols.items()}))
            begin = 0
            for end in (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist():
                found.append(done({c: v[begin:end] for c, v in cols.items()}))
                begin = end
            held.append({c: v[begin:].copy() for c, v in cols.items()})
            if found := [f for f in found if len(f["a"])]:
                yield pd.DataFrame({c: np.concatenate([f[c] for f in found]) for c in found[0]})
        if held:
            last = held.pop()
            yield pd.DataFrame(done(last))

    return rows.repartition(*CELL).sortWithinPartitions(*CELL, *then).mapInPandas(run, out)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The places of those links of (a, b) that join what no earlier one does."""
    up: dict[int, int] = {}
    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        while up.get(y, y) != y:
            up[y] = y = up.get(up[y], up[y])
        if x != y:
            up[x] = y
            out.append(k)
    return np.array(out, np.int64)


def near(texts: list[str], a: np.ndarray, b: np.ndarray, s: Settings) -> np.ndarray:
    """The places of those pairs (a, b), which are places in texts, whose whole multisets reach the similarity.

    Of links that close a circle only some are given, so there are fewer than texts.
    """
    parts = [(shingles(texts[p], s.words), p.start) for p in portions(texts, 256)]
    run, times, place = (np.concatenate(x) for x in zip(*((r, t, at + first) for (r, t, at), first in parts)))
    words, index = np.unique(run, return_inverse=True)
    first, size = np.searchsorted(place, np.arange(len(texts) + 1)), np.bincount(place, times, len(texts)).astype(np.int64)
    by_a = np.argsort(a, kind="stable")
    dense, real = np.zeros(len(words), np.int64), []
    cuts = np.append(np.flatnonzero(np.append(True, a[by_a][1:] != a[by_a][:-1])), len(a))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        one = a[by_a[lo]]
        own = slice(first[one], first[one + 1])
        dense[index[own]] = times[own]
        for k in range(lo, hi, 256):
            other = b[by_a[k : min(hi, k + 256)]]
            length = first[other + 1] - first[other]
            at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length - first[other], length)
            common = np.bincount(np.repeat(np.arange(len(other)), length), np.minimum(dense[index[at]], times[at]), len(other))
            real.append(by_a[k + np.flatnonzero(common >= s.similarity * (size[one] + size[other] - common) - 1e-9)])
        dense[index[own]] = 0
    real = np.concatenate(real)
    return real[forest(a[real], b[real])]


def overlaps(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(a, b): links with the same components as all those of pairs (a, b, tag, low, high) whose whole multisets reach the similarity.

    A text of texts (rep, text) goes once to each cell that has a pair of it.
    """
    members = pairs.select(*CELL, F.col("a").alias("rep")).unionByName(pairs.select(*CELL, F.col("b").alias("rep"))).distinct()
    rows = texts.join(small_side(members, _BROADCAST_MEMBERS), "rep").select(*CELL, F.lit(0).alias("kind"), F.col("rep").alias("a"), F.lit(0).cast("long").alias("b"), "text")
    rows = rows.unionByName(pairs.select(*CELL, F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("string").alias("text")))

    def compare(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = int((g["kind"] == 0).sum())
        rep = g["a"][:n]
        order = np.argsort(rep, kind="stable")
        a, b = (order[np.searchsorted(rep[order], g[c][n:])] for c in "ab")
        real = near(g["text"][:n].tolist(), a, b, s)
        return {"a": rep[a[real]], "b": rep[b[real]]}

    return by_cell(rows, ["kind"], compare, "a long, b long")


def led(rows: DataFrame, was: DataFrame | None, s: Settings, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pairs to check, leaders so far (key, a)) of one election in each bucket that holds several classes.

    rows: (key, rep, n, class, weight). The leader is the text of most weight that hasn't led; it is paired with the
    bucket's texts of other classes. A leader with many partners has its pairs in several cells.
    """
    free = rows if was is None else rows.join(was.withColumnRenamed("a", "rep"), ["key", "rep"], "left_anti")
    several = rows.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key")
    order = F.struct("weight", F.xxhash64("rep").alias("h"), F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("class").alias("class_a"))
    leader = free.join(several, "key", "left_semi").groupBy("key").agg(F.max(order).alias("l")).select("key", "l.a", "l.n_a", "l.class_a")
    leader = scratch.keep(leader)
    near = (F.col("class") != F.col("class_a")) & (F.least("n", "n_a") >= s.similarity * F.greatest("n", "n_a") - 1e-9)
    pairs = scratch.keep(rows.join(leader, "key").where(near).select("a", F.col("rep").alias("b"), "n").distinct())
    runs = pairs.groupBy("a").agg(F.ceil(F.sum(F.greatest("n", F.lit(_LEAST_RUNS))) / s.block).cast("int").alias("cells"))
    cell = pairs.join(runs, "a").select("a", "b", F.col("a").alias("tag"), F.lit(0).alias("low"), F.pmod(F.xxhash64("b"), F.col("cells")).cast("int").alias("high"))
    leaders = leader.select("key", "a")
    return scratch.keep(cell), leaders if was is None else was.unionByName(leaders)


def resembling(rows: DataFrame, s: Settings) -> DataFrame:
    """(a, b): links with the same components as all pairs of near duplicates of a bucket that are in different classes.

    rows: (key, rep, n, class, bands, sketch, text). The texts of a bucket's largest class meet those of other classes
    only, which also meet one another: both sides are dealt to blocks, and a cell holds two blocks. There a pair
    that size and signature let be near, in the first band that it shares, is compared by its multisets.
    """
    weight = F.greatest("n", F.lit(_LEAST_RUNS))
    by_class = rows.groupBy("key", "class").agg(F.sum(weight).alias("runs"))
    most = by_class.groupBy("key").agg(F.max(F.struct("runs", "class")).alias("top"), F.sum("runs").alias("all"), F.count("*").alias("classes")).where("classes > 1")
    blocks = most.select("key", F.col("top.class").alias("largest"), F.ceil((F.col("all") - F.col("top.runs")) / s.block).cast("int").alias("others"), F.ceil(F.col("top.runs") / s.block).cast("int").alias("own_blocks"))
    cells = rows.join(blocks, "key").withColumn("in_largest", F.col("class") == F.col("largest"))
    hashed = F.xxhash64("rep", F.lit(1))
    cells = cells.withColumn("own", F.when(F.col("in_largest"), F.col("others") + F.pmod(hashed, F.col("own_blocks"))).otherwise(F.pmod(hashed, F.col("others"))).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("in_largest"), F.col("others") - 1).otherwise(F.col("others") + F.col("own_blocks") - 1))))
    cells = cells.select(F.col("key").alias("tag"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "n", "class", "bands", "sketch", "text")

    def compare(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        rep, n, named, own = (g[c] for c in ("rep", "n", "class", "own"))
        low, high = g["low"][0], g["high"][0]
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        found = []
        if len(left) and len(right):
            sketch, bands = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(n), -1), np.stack(g["bands"])
            for k in range(0, len(left), 32):
                part = left[k : k + 32]
                a, b = np.nonzero((named[part][:, None] != named[right]) & (np.minimum(n[part][:, None], n[right]) >= s.similarity * np.maximum(n[part][:, None], n[right]) - 1e-9))
                a, b = part[a], right[b]
                if low == high:
                    a, b = a[rep[a] < rep[b]], b[rep[a] < rep[b]]
                for i in range(0, len(a), 4096):
                    x, y = a[i : i + 4096], b[i : i + 4096]
                    can = (sketch[x] == sketch[y]).sum(axis=1) >= s.agreeing
                    x, y = x[can], y[can]
                    same = bands[x] == bands[y]
                    first = bands[x, same.argmax(axis=1)] == g["tag"][0]
                    found.append((x[first], y[first]))
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        if not len(a):
            return {"a": rep[:0], "b": rep[:0]}
        used, at = np.unique(np.append(a, b), return_inverse=True)
        a, b = at[: len(a)], at[len(a) :]
        real = near([g["text"][k] for k in used], a, b, s)
        return {"a": rep[used[a[real]]], "b": rep[used[b[real]]]}

    return by_cell(cells, [], compare, "a long, b long")


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id) of every row of docs (doc_id, text); class_id is the least doc_id of the class."""
    scratch = Scratch(docs.sparkSession)
    try:
        return stored(_classes(docs, s, scratch))
    finally:
        scratch.close()


def _classes(docs: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    rows = scratch.keep(signed(docs, s))
    again = rows.groupBy("doc_id").agg(F.count("*").alias("times"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("print_a", "print_b") for f in (F.min, F.max)]).where("times > 1")
    again = scratch.keep(again.select("doc_id", F.expr("min_print_a <> max_print_a OR min_print_b <> max_print_b").alias("differ")))
    repeats, several = not again.isEmpty(), again.where("differ").select("doc_id")
    several = None if several.isEmpty() else several
    # A print goes by its least doc_id, unless a document can hold several prints: then by a number of its own.
    reps = rows.groupBy("print_a", "print_b").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = scratch.keep(reps.withColumn("rep", F.col("doc_id") if several is None else F.monotonically_increasing_id()))
    ids = scratch.keep(rows.select("doc_id", "print_a", "print_b").join(reps.select("print_a", "print_b", "rep", F.col("doc_id").alias("least")), ["print_a", "print_b"]).select("doc_id", "rep", "least"))
    found, labels = None, None
    if several is not None:
        # A document links all its prints.
        own = ids.join(small_side(several), "doc_id", "left_semi")
        found = scratch.keep(own.join(own.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct())
        labels = components(found, scratch)

    # A band's key holds its number, so the key alone names a bucket.
    each = reps.where("n > 0").select("rep", "n", F.explode("bands").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.keep(each.join(shared, "key"))
    # Texts that share large buckets in many bands are close to many others: these lead their buckets.
    central = members.groupBy("rep").agg(F.round(F.sum(F.log("size")), 6).alias("weight"))
    members = scratch.keep(members.join(central, "rep").select("key", "rep", "n", "weight"))
    wanted = scratch.keep(members.select("rep").distinct().join(reps.select("rep", "doc_id", "print_a", "print_b"), "rep"))
    texts = scratch.keep(texts_of(docs, wanted, several, repeats, s))

    def labelled() -> DataFrame:
        if labels is None:
            return members.withColumn("class", F.col("rep"))
        return members.join(labels, F.col("rep") == F.col("node"), "left").withColumn("class", F.coalesce("class", "rep")).drop("node")

    leaders, more = None, True
    while more:
        pairs, leaders = led(labelled(), leaders, s, scratch)
        checked = pairs.count()
        new = scratch.keep(overlaps(pairs, texts, s))
        linked = new.count()
        if linked:
            found = new if found is None else found.unionByName(new)
            labels = components(found, scratch)
        more = linked > 0 and linked >= s.worth * checked
    rest = labelled()
    mixed = rest.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key")
    rest = scratch.keep(rest.join(mixed, "key", "left_semi").select("key", "rep", "n", "class"))
    whole = texts.join(small_side(rest.select("rep").distinct()), "rep", "left_semi").join(reps.select("rep", "bands", "sketch"), "rep")
    new = scratch.keep(resembling(rest.join(whole, "rep"), s))
    if not new.isEmpty():
        labels = components(new if found is None else found.unionByName(new), scratch)
    everyone = ids.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.min("least").alias("least"))
    if labels is None:
        return everyone.select("doc_id", F.col("least").alias("class_id"))
    if several is not None:
        # Numbers of prints to the least doc_id of their class.
        lowest = labels.join(reps.select(F.col("rep").alias("node"), F.col("doc_id").alias("least")), "node")
        labels = labels.join(lowest.groupBy("class").agg(F.min("least").alias("lowest")), "class").select("node", F.col("lowest").alias("class"))
    return everyone.join(labels, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("class", "least").alias("class_id"))


def deduplicated(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of docs whose doc_id is the least of its class, one row for each; rows without doc_id stay."""
    drop = classes(docs.select("doc_id", "text"), s).where("doc_id <> class_id").select(F.col("doc_id").alias("dropped"))
    drop = small_side(drop)
    kept = docs.join(drop, docs["doc_id"].cast("long") == drop["dropped"], "left_anti")
    repeated = cut(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    once = kept.join(F.broadcast(repeated) if repeated.count() <= 100_000 else repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once.select(*docs.columns))
