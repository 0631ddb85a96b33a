"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts earlier are removed.

Earlier means in a document of smaller id, or in the same document further to the front. Strings are judged on the input.

1. Texts that equal an earlier one whole go at once; the first of each is stored in a table bucketed by shard, a
   hash of the id, so that later steps read shards without shuffling texts again.
2. Every string of `length` bytes has an anchor: the least hash of the grams of `gram` bytes in it. Equal strings have equal
   anchors, and neighbouring strings mostly share one. Each shard names its anchors once; those of one shard only, once, can't
   begin a repeat.
3. Each shard sorts the suffixes of the stretches that are left by Larsson and Sadakane's refinement: by 8 bytes,
   then by the rank of the suffix 8, 16, 32, ... bytes on, looking only at groups that are still tied. Kasai's common
   prefixes cut the order into classes of equal strings. All but the first of a class are removed.
4. The distinct strings of a shard with anchors that other shards have go to a task by anchor, as pieces of text. There the
   shards' strings are looked up by binary search in the merged list of all, and all but the earliest are removed. An anchor
   with more than `hot` pieces is dealt out by the strings' own hashes instead. Hashes are only where to look: each find is
   compared as text.
5. The removed spans go back to their shards and are cut out.

A shard holds about `shard_bytes` of text, a task of step 4 `portion` bytes or the pieces of one anchor, whichever is more.

Null texts count as empty; a null id counts as the least long. Rows that repeat an id with other texts are ordered by a
hash of the text, equal rows have equal results. Texts of fewer than `length` bytes stay whole. An empty table gives an
empty one. Only the id and the operator's own columns are returned, so the names of others can't clash.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortarium.llm.common import _BASE, _BYTE, Scratch, _powers, mix, stored, tidied


@dataclass(frozen=True)
class Settings:
    length: int = 100
    gram: int = 36
    shard_bytes: int = 4_000_000
    hot: int = 20_000
    portion: int = 1_000_000

    def __post_init__(self):
        if not 1 <= self.gram <= self.length:
            raise ValueError("grams are no longer than the strings")


#: Starts whose hashes are made at once, small enough for the arrays to stay in a core's cache.
_BLOCK = 1 << 17
_NO_ID = -(1 << 63)
PIECE = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("text", pa.binary())])
SPAN = pa.schema([f for f in PIECE if f.name in ("id", "tie", "start", "stop")])


# --- hashes of grams and the anchors of strings


def gram_hashes(some: np.ndarray, k: int, power: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """A hash for each of the len(some) - k + 1 grams of k bytes, from prefix sums of a polynomial."""
    n = len(some)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[some] * power[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


def hashes(some: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first start, hashes of the grams of k bytes from there on), block by block."""
    power, inverse = _tables(min(_BLOCK, len(some)) + k)
    for at in range(0, len(some) - k + 1, _BLOCK):
        yield at, gram_hashes(some[at : at + _BLOCK + k - 1], k, power, inverse)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    m, done = h, 1
    while done * 2 <= width:
        m, done = np.minimum(m[:-done], m[done:]), done * 2
    return m if done == width else np.minimum(m[: len(m) - (width - done)], m[width - done :])


class Shard:
    """The texts of a shard in the order of ids, a byte that UTF-8 doesn't use behind each, and the anchors of their strings."""

    def __init__(self, texts: pa.Table, want: Settings):
        order = np.lexsort((texts["tie"].to_numpy(), texts["id"].to_numpy()))
        self.ids, self.ties, self.want = texts["id"].to_numpy()[order], texts["tie"].to_numpy()[order], want
        raw = [t.as_buffer() for t in texts["text"].combine_chunks().take(pa.array(order))] if len(order) else []
        sizes = np.array([r.size for r in raw], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.stream = np.frombuffer(b"".join(x for r in raw for x in (r, b"\xff")), np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first start, start behind the last, anchor) of stretches of strings whose anchor first stands at one place, in their order.

        Equal strings have their anchor at one distance from their starts, so they never share a stretch.
        """
        length, gram = self.want.length, self.want.gram
        fits = np.ones(len(self.stream), bool)
        for begin, end in zip(self.starts.tolist(), self.ends.tolist()):
            fits[max(begin, end - length + 1) : end + 1] = False
        found = []
        power, inverse = _tables(min(_BLOCK, len(self.stream)) + length)
        for at in range(0, len(self.stream) - length + 1, _BLOCK):
            grams = gram_hashes(self.stream[at : at + _BLOCK + length - 1], gram, power, inverse)
            m = _least(grams, length - gram + 1)
            ok = fits[at : at + len(m)]
            # a string that begins with its anchor is the last with the anchor at that place
            edge = np.flatnonzero((m[1:] != m[:-1]) | (m[:-1] == grams[: len(m) - 1]) | (ok[1:] != ok[:-1])) + 1
            low, high = np.append(0, edge), np.append(edge, len(m))
            inside = ok[low]
            found.append((low[inside] + at, high[inside] + at, m[low[inside]]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0], ..., high[0] - 1, low[1], ..."""
    sizes = high - low
    return np.arange(int(sizes.sum())) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)


def joined(places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of [p, p + length) over ascending places, as (starts, stops) that don't touch."""
    new = np.flatnonzero(np.append(True, places[1:] > places[:-1] + length)) if len(places) else np.zeros(0, np.int64)
    return places[new], (places[np.append(new[1:], len(places)) - 1] + length) if len(places) else places


# --- suffix arrays


def words_at(x: np.ndarray) -> np.ndarray:
    """The first 8 bytes of every suffix as a number that sorts like them; zeros stand behind the end."""
    padded = np.append(x, np.zeros(8, np.uint8)).astype(np.uint64)
    out = np.zeros(len(x), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(x)] << np.uint64(56 - 8 * k)
    return out


def suffix_array(x: np.ndarray) -> np.ndarray:
    """The suffixes of x in their order, by Larsson and Sadakane's refinement.

    rank is the first slot of a suffix's group. A round sorts the slots of tied groups by (group, rank of the suffix h on) and
    splits them, which doubles the bytes that are sorted by; groups of one are never looked at again.
    """
    n, h = len(x), 8
    key = words_at(x)
    sa = np.argsort(key)
    key = key[sa]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    sizes = np.diff(np.append(first, n))
    rank[sa] = np.repeat(first, sizes)
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(slots):
        p = sa[slots]
        # of suffixes that end within h bytes the shorter comes first
        behind = np.where(p + h < n, rank[np.minimum(p + h, n - 1)], -1 - p)
        pair = rank[p] * (2 * n + 1) + behind + n
        order = np.argsort(pair)
        p, pair = p[order], pair[order]
        sa[slots] = p
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        sizes = np.diff(np.append(first, len(p)))
        rank[p] = np.repeat(slots[first], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        h *= 2
    return sa


def common_prefixes(x: np.ndarray, sa: np.ndarray, depth: int, lanes: int = 4096) -> np.ndarray:
    """For every slot the bytes, at most `depth`, that its suffix shares with that of the slot before (0 for the first).

    Kasai's walk goes through the suffixes in the order of the text and drops at most one byte from each to the next. Here
    it starts in many places at once, and all walks take a step at a time, comparing eight bytes at once.
    """
    n = len(x)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    word = np.append(words_at(x), np.zeros(depth + 8, np.uint64))
    slot = np.empty(n, np.int64)
    slot[sa] = np.arange(n)
    stride = -(-n // max(1, min(lanes, n // 64)))
    i = np.arange(0, n, stride)
    begin, h = i, np.zeros(len(i), np.int64)
    limits = [np.uint64(1 << (8 * k)) for k in range(8)]
    for step in range(stride):
        i = begin + step
        if step and i[-1] >= n:
            i, begin, h = i[:-1], begin[:-1], h[:-1]
            if not len(i):
                break
        at = slot[i]
        j = sa[at - 1]
        open_ = np.flatnonzero(at > 0)
        while len(open_):
            differ = word[i[open_] + h[open_]] ^ word[j[open_] + h[open_]]
            same = sum(differ < limit for limit in limits).astype(np.int64)
            h[open_] += same
            open_ = open_[(same == 8) & (h[open_] < depth)]
        # words behind the text's end are zeros, which bytes of the text may equal
        h = np.where(at > 0, np.minimum(np.minimum(h, depth), n - np.maximum(i, j)), 0)
        out[at] = h
        h = np.maximum(h - 1, 0)
    return out


def first_of_class(x: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For each of the starts the least start with the same `depth` bytes; from each of them so many bytes follow."""
    sa = suffix_array(x)
    lcp = common_prefixes(x, sa, depth)
    wanted = np.zeros(len(x), bool)
    wanted[starts] = True
    class_of = np.cumsum(lcp < depth)
    slots = np.flatnonzero(wanted[sa])
    if not len(slots):
        return starts
    classes, places = class_of[slots], sa[slots]
    bounds = np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))
    first = np.empty(len(x), np.int64)
    first[places] = np.repeat(np.minimum.reduceat(places, bounds), np.diff(np.append(bounds, len(slots))))
    return first[starts]


# --- the steps, by shard and by anchor


def named(texts: pa.Table, want: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, stretches that have it) of a shard."""
    return np.unique(Shard(texts, want).anchors()[2], return_counts=True)


def sorted_out(texts: pa.Table, others: np.ndarray, hot: np.ndarray, want: Settings) -> pa.Table:
    """Rows of PIECE: spans to remove (no text), and pieces of distinct strings whose anchors are among `others`, ascending."""
    shard, length = Shard(texts, want), want.length
    low, high, anchor = shard.anchors()
    names, place, times = np.unique(anchor, return_inverse=True, return_counts=True)
    has = lambda values, among: among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values if len(among) else np.zeros(len(values), bool)
    apart = has(names, others)
    can = (apart | (times > 1))[place]
    low, high, anchor, apart, hot_ = low[can], high[can], anchor[can], apart[place][can], has(names, hot)[place][can]
    if not len(low):
        return PIECE.empty_table()
    # the stretches of text that the strings left over cover, one behind the other
    new = np.flatnonzero(np.append(True, low[1:] > high[:-1] + length - 1))
    begin, end = low[new], high[np.append(new[1:], len(low)) - 1] + length - 1
    x = shard.stream[_ranges(begin, end)]
    shift = np.cumsum(end - begin) - (end - begin) - begin
    stretch = np.repeat(np.arange(len(low)), high - low)
    starts = _ranges(low, high)
    moved = starts + shift[np.searchsorted(begin, low, "right") - 1][stretch]
    is_first = first_of_class(x, moved, length) == moved
    gone_from, gone_to = joined(starts[~is_first], length)
    # pieces: neighbouring first strings of one stretch; those of hot anchors one by one
    kept = np.flatnonzero(is_first & apart[stretch])
    p, s = starts[kept], stretch[kept]
    cut = np.flatnonzero(np.append(True, (p[1:] != p[:-1] + 1) | (s[1:] != s[:-1]) | hot_[s[1:]])) if len(p) else np.zeros(0, np.int64)
    piece_from, piece_to = p[cut], (p[np.append(cut[1:], len(p)) - 1] + length) if len(p) else p
    key = anchor[s[cut]].copy()
    alone = np.flatnonzero(hot_[s[cut]])
    if len(alone):
        strings = np.lib.stride_tricks.sliding_window_view(shard.stream, length)
        power, inverse = _tables(length)
        for part in np.array_split(alone, -(-len(alone) // 4096)):
            key[part] = mix(np.cumsum(_BYTE[strings[piece_from[part]]] * power, axis=1, dtype=np.uint64)[:, -1])
    text = shard.text_of(np.append(gone_from, piece_from))
    key = np.append(mix(gone_from.astype(np.uint64) + np.uint64(shard.ids[0] & 0xFFFF)), key)
    raw = shard.stream.tobytes()
    pieces = [None] * len(gone_from) + [raw[a:b] for a, b in zip(piece_from.tolist(), piece_to.tolist())]
    columns = [key.view(np.int64), shard.ids[text], shard.ties[text], np.append(gone_from, piece_from) - shard.starts[text], np.append(gone_to, piece_to) - shard.starts[text]]
    return pa.Table.from_arrays([*map(pa.array, columns), pa.array(pieces, pa.binary())], schema=PIECE)


def merged(pieces: pa.Table, want: Settings) -> pa.Table:
    """Rows of SPAN: what earlier pieces with the same key hold as well. All pieces of a key are here."""
    length = want.length
    key, ids, ties, start = (pieces[c].to_numpy() for c in ("key", "id", "tie", "start"))
    order = np.lexsort((start, ties, ids))
    raw = pieces["text"].combine_chunks().take(pa.array(order))
    sizes = pc.binary_length(raw).to_numpy().astype(np.int64)
    data = b"".join(t.as_buffer() for t in raw)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    x = np.frombuffer(data, np.uint8)
    places = _ranges(begins, ends - length + 1)
    piece = np.repeat(np.arange(len(order)), sizes - length + 1)
    string = np.empty(max(0, len(x) - length + 1), np.uint64)
    for at, h in hashes(x, length):
        string[at : at + len(h)] = h
    string = mix(string[places] ^ mix(key[order].view(np.uint64))[piece])
    # every string is looked up in the merged list; places ascend with ids, so the first of a string is the earliest
    listed, first = np.unique(string, return_index=True)
    earliest = places[first][np.searchsorted(listed, string)]
    later = np.flatnonzero(earliest < places)
    if len(later):
        step = (np.diff(places[later]) != 1) | (np.diff(earliest[later]) != 1) | (np.diff(piece[later]) != 0)
        cut = np.flatnonzero(np.append(True, step))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(later)).tolist()):
            here, there, n = int(places[later[a]]), int(earliest[later[a]]), b - a + length - 1
            if data[here : here + n] != data[there : there + n]:  # two strings of one hash: look all of them up as text
                seen: dict[tuple[int, bytes], int] = {}
                of = key[order]
                later = np.array([k for k, (q, i) in enumerate(zip(places.tolist(), piece.tolist())) if seen.setdefault((int(of[i]), data[q : q + length]), q) != q], np.int64)
                break
    # neighbours of one piece; pieces don't touch once they are a byte apart
    begin, end = joined(places[later] + piece[later], length)
    owner = np.searchsorted(ends + np.arange(len(ends)), begin, "right")
    offset = start[order][owner] - begins[owner] - owner
    return pa.Table.from_arrays([pa.array(v) for v in (ids[order][owner], ties[order][owner], begin + offset, end + offset)], schema=SPAN)


def _merge(want: Settings):
    """Batches sorted by key to rows of SPAN; the pieces of whole keys are in hand, about `portion` bytes of them."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            some = pa.Table.from_batches([batch])
            is_span = some["text"].is_null()
            yield from some.filter(is_span).select(SPAN.names).cast(SPAN).to_batches()
            some = some.filter(pc.invert(is_span))
            if not some.num_rows:
                continue
            held.append(some)
            size += some["text"].nbytes
            if size >= want.portion:
                whole = pa.concat_tables(held)
                key = whole["key"].to_numpy()
                n = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
                if n:
                    yield from merged(whole.slice(0, n), want).to_batches()
                held = [whole.slice(n)]
                size = held[0]["text"].nbytes
        if held:
            yield from merged(pa.concat_tables(held), want).to_batches()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)

    return spans


KEPT = "id long, tie long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"


def _cut_out(texts: pa.Table, spans: pa.Table) -> pa.Table:
    """Rows of KEPT, as many of each text as it has `times`."""
    by_text: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, t, a, b in zip(*(spans[c].to_pylist() for c in SPAN.names)):
        by_text.setdefault((i, t), []).append((a, b))
    rows = []
    for i, t, times, raw in zip(*(texts[c].to_pylist() for c in ("id", "tie", "times", "text"))):
        whole, out, at = [], [], 0
        for a, b in sorted(by_text.get((i, t), ())):
            if whole and a <= whole[-1][1]:
                whole[-1] = (whole[-1][0], max(b, whole[-1][1]))
            else:
                whole.append((a, b))
        for a, b in whole:
            out.append(raw[at:a])
            at = b
        rows += [(i, t, len(raw), [{"start": a, "stop": b} for a, b in whole], b"".join([*out, raw[at:]]))] * times
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), kind, pa.binary())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "tie", "n_bytes", "spans", "kept"])


def _shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")


class Work(Scratch):
    """The scratch tables of this operator; one of them is in the session's catalogue, for its buckets."""

    def __init__(self, spark):
        super().__init__(spark)
        self.names: list[str] = []

    def bucketed(self, df: DataFrame, buckets: int) -> DataFrame:
        name = f"shards_{uuid.uuid4().hex}"
        df.write.format("parquet").option("path", f"{self.root}/{name}").option("compression", "zstd").bucketBy(buckets, "shard").sortBy("shard").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        super().close()


def deduplicated(docs: DataFrame, work: Work, want: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, spans (of bytes removed) and kept (the bytes left) of every row; read it before work is closed."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "n_bytes": F.octet_length("text").cast("long")})
    long_ = rows.where(F.col("n_bytes") >= want.length)
    marks = work.keep(long_.select("id", "tie", "n_bytes", F.unhex(F.sha2("text", 256)).alias("digest")))
    total = marks.agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(1, math.ceil(total / want.shard_bytes))
    firsts = marks.groupBy("digest", "id", "tie").agg(F.count("*").alias("times")).groupBy("digest").agg(F.min(F.struct("id", "tie", "times")).alias("f")).select("f.*")
    firsts = work.keep(firsts)

    def only_first(some: pa.Table, first: pa.Table) -> pa.Table:
        times = {(i, t): n for i, t, n in zip(*(first[c].to_pylist() for c in ("id", "tie", "times")))}
        here, seen = [], set()
        for k, at in enumerate(zip(some["id"].to_pylist(), some["tie"].to_pylist())):
            if at in times and at not in seen:
                seen.add(at)
                here.append(k)
        out = some.select(["shard", "id", "tie", "text"]).take(pa.array(here, pa.int64()))
        return out.append_column("times", pa.array([times[at] for at in zip(out["id"].to_pylist(), out["tie"].to_pylist())], pa.int64()))

    by_shard = lambda df: df.withColumn("shard", _shard_of(shards)).groupBy("shard")
    sharded = by_shard(long_.select("id", "tie", F.col("text").cast("binary").alias("text"))).cogroup(by_shard(firsts))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / 256e6))
    texts = work.bucketed(sharded.applyInArrow(only_first, "shard int, id long, tie long, text binary, times long"), buckets)

    def anchors(some: pa.Table) -> pa.Table:
        found, times = named(some, want)
        return pa.table({"shard": pa.array(np.full(len(found), some["shard"][0].as_py(), np.int32)), "anchor": pa.array(found.view(np.int64)), "times": pa.array(times)})

    held = texts.groupBy("shard").applyInArrow(anchors, "shard int, anchor long, times long").alias("held")
    everywhere = F.expr("count(*) OVER (PARTITION BY anchor)"), F.expr("sum(times) OVER (PARTITION BY anchor)")
    common = held.select("shard", "anchor", everywhere[0].alias("in_shards"), everywhere[1].alias("pieces")).where("in_shards > 1")
    common = common.select("shard", "anchor", (F.col("pieces") > want.hot).alias("hot"))

    def pieces(some: pa.Table, known: pa.Table) -> pa.Table:
        if not some.num_rows:
            return PIECE.empty_table()
        others, hot = known["anchor"].to_numpy().view(np.uint64), known["hot"].to_numpy().astype(bool)
        return sorted_out(some, np.sort(others), np.sort(others[hot]), want)

    found = texts.groupBy("shard").cogroup(common.groupBy("shard")).applyInArrow(pieces, "key long, id long, tie long, start long, stop long, text binary")
    spans = found.repartition("key").sortWithinPartitions("key").mapInArrow(_merge(want), "id long, tie long, start long, stop long")
    cut = texts.groupBy("shard").cogroup(by_shard(spans)).applyInArrow(_cut_out, KEPT).drop("tie")

    copies = marks.join(firsts, ["id", "tie"], "left_anti")
    span = "array<struct<start: bigint, stop: bigint>>"
    copies = copies.select("id", "n_bytes", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop"))).cast(span).alias("spans"), F.lit(b"").alias("kept"))
    short = rows.where(F.col("n_bytes") < want.length).select("id", "n_bytes", F.array().cast(span).alias("spans"), F.col("text").cast("binary").alias("kept"))
    return cut.unionByName(copies).unionByName(short).select(F.expr(f"nullif(id, {_NO_ID + 1}L - 1L)").alias(key), "n_bytes", "spans", "kept")


def digests(docs: DataFrame, want: Settings = Settings()) -> DataFrame:
    """doc_id, bytes, bytes removed, removed spans and the digest of what stays, from a table in the shared folder."""
    work = Work(docs.sparkSession)
    out = deduplicated(docs, work, want)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    out = stored(out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")))
    work.close()
    return out
