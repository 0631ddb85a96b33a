"""What the operators of this subpackage share: reading tables, cutting lineage, hashing words, exact ranks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of ids or of tree leaves may be broadcast (about 16 MB of longs).
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Where none is set, a session on this machine alone gets a temporary one, and a cluster a folder in its warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jsc.isDefined():
            return jsc.get()
        alone = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        root = f"{tempfile.gettempdir() if alone else spark.conf.get('spark.sql.warehouse.dir')}/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, for small tables that are read again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark has it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


#: Folders of stored() that nobody has deleted, for a caller that knows when their readers are done.
STORED: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, for tables that a result still reads."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Parquet tables in the shared folder that go when the work that needs them is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.made = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows, from a table of their own."""
        path = f"{self.root}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Deletes the tables; nothing that reads them may run afterwards."""
        removed(self.spark, self.root)


def _cuts(sizes: list[int], rows: int, chars: int) -> Iterator[slice]:
    begin = size = 0
    for k, n in enumerate(sizes):
        if k > begin and (k - begin >= rows or size + n > chars):
            yield slice(begin, k)
            begin, size = k, 0
        size += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def portions(texts: list[str | None], rows: int, chars: int = 400_000) -> Iterator[slice]:
    """Slices of at most `rows` texts and about `chars` characters, a longer text having one of its own."""
    return _cuts([len(t) if t else 0 for t in texts], rows, chars)


def slices(texts: pa.Array, rows: int, chars: int = 400_000) -> Iterator[tuple[slice, list[str | None]]]:
    """The same of an Arrow column, by bytes; only one slice at a time is turned into Python's strings."""
    for part in _cuts(pc.binary_length(texts).fill_null(0).to_pylist(), rows, chars):
        yield part, texts.slice(part.start, part.stop - part.start).to_pylist()


#: What a worker keeps from task to task, by owner: functions that let go of it.
HELD: dict[str, Callable[[], None]] = {}


def let_go(owner: str) -> None:
    for name, free in HELD.items():
        if name != owner:
            free()


def tidied(run, owner: str = ""):
    """run, a function from batches to batches, that gives freed memory back to the system once its batches end.

    Python workers live on for later stages; without this, each would hold the peak of every stage before. What
    owners other than run's own keep in HELD goes before run begins, for their stage is over by then.
    """

    def tidy(batches):
        let_go(owner)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # no such call outside glibc
                pass

    return tidy


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has been counted to at most `rows` rows; else df, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def text_udf(run, kind: str, rows: int = 128):
    """The Arrow UDF of run, a function from a list of texts to an array of as many values; a slice of texts is in hand at a time."""

    @tidied
    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [run(texts) for _, texts in slices(batch, rows)]
            yield pa.array(np.concatenate(out) if out else [], kind)

    def arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from column(batches)

    return F.arrow_udf(arrays, {"float64": "double"}[kind])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: uint64 to uint64, every input bit reaching every output bit."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes by kind: 1 in words (ASCII letters and digits, and every byte beyond ASCII), 2 symbols, 0 the rest.
_KIND = np.array([1 if c >= 128 or chr(c).isalnum() else 2 if 32 < c < 127 else 0 for c in range(256)], np.uint8)
_WORDS_ONLY = np.where(_KIND == 2, 0, _KIND).astype(np.uint8)
_BYTE = mix(np.arange(256, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at once, small enough for the arrays to stay in a core's cache.
_BLOCK = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & ((1 << 64) - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_powers_of = {n: (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)) for n in (_BLOCK + 1,)}


def _blocks(texts: list[bytes]) -> Iterator[bytes]:
    """The texts, each ended by a line feed, in blocks that begin and end between words."""
    held, size = [], 0
    for t in texts:
        if size + len(t) >= _BLOCK and held:
            yield b"".join(held)
            held, size = [], 0
        while len(t) >= _BLOCK:
            at = max(t.rfind(b" ", 0, _BLOCK), t.rfind(b"\n", 0, _BLOCK)) + 1
            at = at or min((x for x in (t.find(b" "), t.find(b"\n")) if x >= 0), default=len(t) - 1) + 1
            yield t[:at]
            t = t[at:]
        held += [t, b"\n"]
        size += len(t) + 1
    yield b"".join(held)


def word_hashes(texts: list[str | None], symbols: bool = False, lower: bool = True, stems: tuple[int, ...] = ()):
    """(hash of each word, its text's place, [hash of its first k bytes or 0 if it has no more, for k in stems]).

    Words are runs of ASCII letters, digits and characters beyond ASCII; with symbols, runs of other
    visible ASCII characters count too. A polynomial hash of every run comes from prefix sums over the
    bytes, without a loop over words.
    """
    raw = [(t.lower() if lower else t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    kind, hashes, starts, others, base = _KIND if symbols else _WORDS_ONLY, [], [], [[] for _ in stems], 0
    for block in _blocks(raw):
        b = np.frombuffer(block, np.uint8)
        n = len(b)
        k = kind[b]
        edge = np.flatnonzero(k[1:] != k[:-1]) + 1
        st, en = np.append(0, edge) if n else edge, np.append(edge, n) if n else edge
        inside = k[st] != 0 if n else np.zeros(0, bool)
        st, en = st[inside], en[inside]
        if n + 1 not in _powers_of and n > _BLOCK:
            power, inverse = _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1)
        else:
            power, inverse = _powers_of[_BLOCK + 1]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[b] * power[:n], out=sums[1:])
        hashes.append((sums[en] - sums[st]) * inverse[st])
        starts.append(st + base)
        for out, length in zip(others, stems):
            longer = en - st > length
            out.append(np.where(longer, mix((sums[np.minimum(st + length, n)] - sums[st]) * inverse[st]), np.uint64(0)))
        base += n
    ends = np.cumsum([len(t) + 1 for t in raw])
    at = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(ends, at, "right"), [np.concatenate(x) for x in others]


def kth_largest(df: DataFrame, key: str, k: int, bins: int = 4096) -> tuple[int, int] | None:
    """(value, rows above it) of the k-th largest value of a long column, exactly, for 1 <= k <= rows; else None.

    Each pass counts the rows in `bins` equal ranges of the values still possible and narrows to
    one range, so the driver sees `bins` counts a pass however many rows there are.
    """
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if not 1 <= k <= (n or 0):
        return None
    above = 0
    while lo < hi:
        width = -(-(hi - lo + 1) // bins)
        counts = dict(df.where(F.col(key).between(lo, hi)).groupBy(F.expr(f"({key} - {lo}L) div {width}L").alias("bin")).count().collect())
        for b in sorted(counts, reverse=True):
            if above + counts[b] >= k:
                break
            above += counts[b]
        lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
    return lo, above
