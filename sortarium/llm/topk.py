"""Exact top-k search by inner product, with bounds from segment statistics at several resolutions.

Vectors are turned by an orthogonal basis that puts most of their energy first (the principal directions
of the block of queries) and cut into segments. With mean m and deviation d of each segment of length L,
the squared distance of two vectors is at least the sum of L * ((m1 - m2)^2 + (d1 - d2)^2), which bounds
their inner product from above by the sum of L * (m1 * m2 + d1 * d2). Resolutions are taken coarse to
fine; a pair that falls below the query's k-th best score so far is out, a vector without any pair left
is not looked at again, and only what survives the finest bound gets an exact integer product.

Queries go out in blocks of a fixed number; each block passes over all vectors, which stay where they
are, and every task returns k rows a query at most, which are written before the next block is sent. A
block's first thresholds come from its own rows.

Components are quantised to floor(scale * x). Vectors that are null, or hold null or non-finite
components, take no part, nor do null ids, nor vectors with a component so large that an inner product
might not fit into a long (beyond sqrt(2^63 / dimensions) once quantised). Shorter vectors count as
filled up with zeros. Rows that repeat a vec_id count as one vector: the best score as a candidate, any
one of them as a query. A query never meets its own id. Empty tables give no rows; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortarium.llm.common import Scratch, stored, tidied


@dataclass(frozen=True)
class Settings:
    """segments: the resolutions, as shares of the dimensions. block queries are broadcast at a time; tile queries meet rows vectors at once."""

    k: int = 5
    scale: float = 256.0
    segments: tuple[float, ...] = (0.25, 0.5, 0.75)
    block: int = 16_384
    tile: int = 512
    rows: int = 4096


def quantised(array: pa.Array, dim: int, scale: float) -> np.ndarray:
    """rows x dim whole numbers, from a list column without nulls."""
    lengths = np.diff(array.offsets.to_numpy())
    values = np.floor(scale * array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    if len(lengths) and (lengths == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def compacting(q: np.ndarray) -> np.ndarray:
    """An orthogonal basis, as columns, in order of the energy that q has along them."""
    if not q.size:
        return np.eye(q.shape[1])
    x = q.astype(np.float64)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def statistics(x: np.ndarray, share: float) -> np.ndarray:
    """Per vector the means and deviations of its segments, scaled so that their product bounds the inner product."""
    dim = x.shape[1]
    n = min(dim, max(1, round(share * dim)))
    # The long segments come last, where the energy is least.
    sizes = np.sort([len(p) for p in np.array_split(np.arange(dim), n)])
    begin = np.cumsum(sizes) - sizes
    total, squares = np.add.reduceat(x, begin, axis=1), np.add.reduceat(x * x, begin, axis=1)
    return np.concatenate([total / np.sqrt(sizes), np.sqrt(np.maximum(squares - total * total / sizes, 0))], axis=1)


class Best:
    """The k best (score, id) of each query so far. left counts the pairs met and those that survive each resolution."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, s: Settings, basis: np.ndarray | None = None):
        self.ids, self.q, self.s = ids, q, s
        self.basis = compacting(q) if basis is None else basis
        turned = q.astype(np.float64) @ self.basis
        self.stats = [statistics(turned, n) for n in s.segments] if q.shape[1] else []
        self.length = np.sqrt((turned * turned).sum(1))
        self.floor = np.full(len(ids), -np.inf)
        self.rows = (np.empty(0, np.int64),) * 3
        self.left = np.zeros(len(s.segments) + 1, np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids) or not len(self.ids):
            return
        turned = x.astype(np.float64) @ self.basis
        length = np.sqrt((turned * turned).sum(1))
        theirs = [statistics(turned, n) for n in self.s.segments] if x.shape[1] else []
        for k in range(0, len(self.ids), self.s.tile):
            self._meet(slice(k, min(k + self.s.tile, len(self.ids))), ids, x, theirs, length)

    def _meet(self, mine: slice, ids: np.ndarray, x: np.ndarray, theirs: list[np.ndarray], length: np.ndarray) -> None:
        least = self.floor[mine] - 1e-7 * (1 + self.length[mine] * length.max())
        at, alive = np.arange(len(ids)), np.ones((len(least), len(ids)), bool)
        self.left[0] += alive.size
        for level, (a, b) in enumerate(zip(self.stats, theirs), 1):
            alive &= a[mine] @ b[at].T >= least[:, None]
            some = alive.any(axis=0)
            at, alive = at[some], alive[:, some]
            self.left[level] += alive.sum()
        query, vec = np.nonzero(alive)
        query, vec = query + mine.start, at[vec]
        score = np.empty(len(query), np.int64)
        for k in range(0, len(query), 65536):
            score[k : k + 65536] = np.einsum("ij,ij->i", self.q[query[k : k + 65536]], x[vec[k : k + 65536]])
        other = (ids[vec] != self.ids[query]) & (score >= self.floor[query])
        if other.any():
            self._merge(query[other], ids[vec[other]], score[other])

    def _merge(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        query, vec, score = (np.concatenate(p) for p in zip(self.rows, (query, vec, score)))
        order = np.lexsort((-score, vec, query))  # first one row an id, the best
        query, vec, score = query[order], vec[order], score[order]
        new = np.append(True, (query[1:] != query[:-1]) | (vec[1:] != vec[:-1]))
        query, vec, score = query[new], vec[new], score[new]
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        first = np.searchsorted(query, query)
        top = np.arange(len(query)) - first < self.s.k
        self.rows = query[top], vec[top], score[top]
        full = np.flatnonzero((np.arange(len(query)) - first)[top] == self.s.k - 1)
        self.floor[self.rows[0][full]] = np.maximum(self.floor[self.rows[0][full]], self.rows[2][full])


def usable(embedding: str = "embedding") -> Column:
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(embedding).isNotNull() & ~F.coalesce(bad, F.lit(True))


def top_k(vectors: DataFrame, queries: Column, s: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of vectors (vec_id, embedding) where `queries` holds, against all rows."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable())
    dim = clean.agg(F.max(F.size("embedding"))).first()[0] or 0
    largest = int((2**63 / max(dim, 1)) ** 0.5) - 1
    clean = clean.where(~F.exists("embedding", lambda v: F.abs(F.lit(s.scale) * v.cast("double")) > float(largest - 1)))
    asked = clean.where(queries)
    blocks = max(1, -(-asked.count() // s.block))
    found = []
    try:
        for b in range(blocks):
            mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).dropDuplicates(["vec_id"]).toArrow()
            ids, q = mine["vec_id"].to_numpy(), quantised(mine["embedding"].combine_chunks(), dim, s.scale)
            seed = Best(ids, q, s)
            for k in range(0, len(ids), s.rows):
                seed.add(ids[k : k + s.rows], q[k : k + s.rows])
            held = spark.sparkContext.broadcast((ids, q, seed.basis, seed.floor))

            @tidied
            def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                ids, q, basis, floor = held.value
                best = Best(ids, q, s, basis)
                best.floor = floor.copy()
                for batch in batches:
                    for k in range(0, batch.num_rows, s.rows):
                        part = batch.slice(k, s.rows)
                        best.add(part.column(0).to_numpy(zero_copy_only=False), quantised(part.column(1), dim, s.scale))
                query, vec, score = best.rows
                yield pa.RecordBatch.from_arrays([pa.array(ids[query], pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

            found.append(scratch.keep(clean.mapInArrow(search, "query_id long, vec_id long, score long")))
            held.destroy()
        rows = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return stored(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    finally:
        scratch.close()


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.e, x.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY rank <= 5
"""
