"""Toxicity by logistic regression over hashed word n-grams and skip-grams, learnt with FTRL-proximal.

Every coordinate has its own learning rate, and an L1 term keeps most weights at exactly zero, so a
fitted model is a short list of (bucket, weight) pairs that every executor can hold.

Null and empty texts have no features and score the model's prior; long texts count whole. Rows of
`labels` that repeat a document count once, toxic if any of them says so; rows with a null label or id
don't count. Repeated documents are scored row by row, and each of their rows teaches; rows with a
null doc_id are scored and never teach. Empty tables give empty results or a model without weights.
Extra columns pass through; the added column replaces any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortarium.llm.common import mix, slices, text_udf, tidied, word_hashes


@dataclass(frozen=True)
class Settings:
    """max_rows and max_features bound the labelled rows that the fit learns from, taken in the order of the hash of
    their ids; a feature is 4 bytes. The scores cover all rows.
    """

    bits: int = 20
    max_skip: int = 1
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    epochs: int = 3
    max_rows: int = 12_000
    max_features: int = 40_000_000
    seed: int = 17


def buckets(texts: list[str | None], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(document's place, bucket) of every unigram, stem, bigram and skip-gram of the texts, repeats included.

    A stem is the first 4 or 5 bytes of a longer word, for languages that inflect or compound.
    A skip-gram is an ordered pair of words with 1 to max_skip words between them.
    """
    h, doc, stems = word_hashes(texts, stems=(4, 5))
    docs, found = [doc], [mix(h)]
    for stem in stems:
        docs.append(doc[stem != 0])
        found.append(mix(stem[stem != 0]))
    for gap in range(1, s.max_skip + 2):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][same])
            kind = np.uint64(gap * 0x51ED2701)
            found.append(mix(mix(h[:-gap][same] + kind) * np.uint64(3) + h[gap:][same]))
    return np.concatenate(docs), (np.concatenate(found) >> np.uint64(64 - s.bits)).astype(np.int64)


def features(texts: list[str | None], s: Settings) -> list[np.ndarray]:
    """The distinct buckets of each text."""
    doc, b = buckets(texts, s)
    keys = (doc << s.bits) | b
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    cuts = np.searchsorted(keys >> s.bits, np.arange(1, len(texts)))
    return [k & ((1 << s.bits) - 1) for k in np.split(keys, cuts)]


def ftrl(rows: list[np.ndarray], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Weights of the buckets, and the bias, after s.epochs passes in a seeded order."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    bz = bn = 0.0
    rng = np.random.default_rng(s.seed)

    def weights(z, n):
        return np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            zx, nx = z[x], n[x]
            w = weights(zx, nx)
            b = -bz / ((s.beta + np.sqrt(bn)) / s.alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - labels[i]
            step = (np.sqrt(nx + g * g) - np.sqrt(nx)) / s.alpha
            z[x] = zx + g - step * w
            n[x] = nx + g * g
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / s.alpha * b
            bn += g * g
    return weights(z, n), -bz / ((s.beta + np.sqrt(bn)) / s.alpha)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) from at most s.max_rows labelled documents (doc_id, text) and (doc_id, toxic).

    Texts become features where they are read. FTRL is sequential, so one task learns, from as many of the
    sample's rows as have s.max_features features at most; only weights other than zero, 2 ** s.bits at most,
    come to the driver. No labelled rows give a model without weights and a bias of zero.
    """
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id", F.lit(s.seed)), "doc_id")
        .limit(s.max_rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), "toxic", "text")

    @tidied
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch.column("text"), 64):
                found = pa.array([x.astype("<i4").tobytes() for x in features(texts, s)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "toxic"]).slice(part.start, len(texts)).columns, found], ["doc_id", "toxic", "features"])

    @tidied
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, marks, free = [], [], s.max_features
        for batch in batches:
            for x, y in zip(batch.column("features"), batch.column("toxic").to_pylist()):
                found = np.frombuffer(x.as_buffer(), "<i4")
                free -= len(found)
                if free >= 0:
                    rows.append(found)
                    marks.append(float(y))
        w, bias = ftrl(rows, np.array(marks), s)
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1), pa.int64()), pa.array(np.append(w[kept], bias), pa.float64())], ["bucket", "weight"])

    rows = sample.mapInArrow(featured, "doc_id long, toxic int, features binary").repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(s.seed)), "doc_id", "features")
    model = rows.mapInArrow(learn, "bucket long, weight double").toPandas()
    inner = model[model.bucket >= 0]
    return inner.bucket.to_numpy(np.int64), inner.weight.to_numpy(float), float(model[model.bucket < 0].weight.sum())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], s: Settings = Settings(), text: str = "text") -> DataFrame:
    """docs and a column score, the probability that a text is toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    dense: list[np.ndarray] = []

    def toxic(texts: list[str | None]) -> np.ndarray:
        at, weight, bias = held.value
        if not dense:
            dense.append(np.zeros(1 << s.bits, np.float32))
            dense[0][at] = weight
        doc, b = buckets(texts, s)
        hit = dense[0][b] != 0
        keys = np.unique((doc[hit] << s.bits) | b[hit])
        total = np.bincount(keys >> s.bits, dense[0][keys & ((1 << s.bits) - 1)], len(texts))
        return 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))

    return docs.withColumn("score", text_udf(toxic, "float64")(F.col(text)))


def held_out(doc_id: str = "doc_id"):
    """True for the rows that never teach: crc32 of the id as text leaves no remainder by 5. False for a null id, which no label has."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
