"""Quality by importance resampling: hashed n-gram models of the target and of the raw text, then Gumbel top-k.

A bag-of-hashed-n-grams model is fitted to texts labelled good (the target) and another to all texts
(the raw model). A document's log importance weight is the sum over its n-grams of the log ratio of
the two; the k documents with the largest weight plus Gumbel noise are a sample without replacement
in proportion to the weights.

A log weight is a sum, so its scale grows with the length of the text, as the method has it: the noise,
whose deviation is 1.28, decides among texts of a few n-grams and among those near the k-th key, and
hardly ever about a long text that the models clearly tell apart.

Null and empty texts have no n-grams and a log weight of 0; long texts count whole. A repeated row has
the same key as its twin, so both are kept or both go; k is exceeded only where rows agree in key and
doc_id. A null doc_id draws its noise like any other value. Rows of labels that repeat count once, those
with null ids or marks not at all. Empty tables give no rows. Extra columns pass through; log_weight,
gumbel_key and selected replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortarium.llm.common import cut, kth_largest, mix, slices, text_udf, tidied, word_hashes

#: What a token that repeats its predecessor is counted as, whatever the token is.
_AGAIN = np.uint64(0xA6A1)


@dataclass(frozen=True)
class Settings:
    """target_rows bounds the labelled rows that the target model is fitted to; the raw model counts all rows.

    smoothing pulls the target model towards the raw one, by so many counts for each count of the target, so that
    weights and odds mean the same however many texts are labelled.
    The budget is keep, a share of the rows. Where none is given it is the number of rows that the models can't rule out: those that the raw model doesn't hold to be
    over `odds` times likelier than the target model does.
    """

    bits: int = 14
    smoothing: float = 0.15
    target_rows: int = 12_000
    keep: float | None = None
    odds: float = 100.0
    seed: int = 29


def ngrams(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document's place, bucket) of every unigram and bigram of words and runs of symbols.

    Case is kept, since shouting is a trait of raw text.
    """
    h, doc, _ = word_hashes(texts, symbols=True, lower=False)
    pair = doc[1:] == doc[:-1]
    two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    two[h[:-1] == h[1:]] = _AGAIN
    found = mix(np.concatenate([h, two[pair]])) >> np.uint64(64 - bits)
    return np.concatenate([doc, doc[1:][pair]]), found.astype(np.int64)


def counts(docs: DataFrame, bits: int) -> np.ndarray:
    """How often each bucket occurs in all texts: an array for each task, summed by bucket."""

    @tidied
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, texts in slices(batch.column("text"), 128):
                total += np.bincount(ngrams(texts, bits)[1], minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    found = docs.select("text").mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits, np.int64)
    out[found.bucket.to_numpy(np.int64)] = found.n
    return out


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """The log ratio of every bucket; zeros if no document is labelled good.

    Labels are (doc_id, quality); a document counts as good if any of its rows says so.
    """
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(s.seed)), "doc_id").limit(s.target_rows)
    target = counts(docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left_semi"), s.bits)
    raw = counts(docs, s.bits)
    if not target.any():
        return np.zeros(len(raw))
    seen = np.maximum(raw, target)
    base = seen / seen.sum()
    mass = s.smoothing * target.sum()
    # A bucket that no text has tells nothing.
    return np.where(seen > 0, np.log((target + mass * base) / ((target.sum() + mass) * np.where(seen > 0, base, 1.0)), where=seen > 0, out=np.zeros(len(raw))), 0.0)


def weigh(docs: DataFrame, ratio: np.ndarray, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """docs and a column log_weight, the log importance weight of each row."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def log_weight(texts: list[str | None]) -> np.ndarray:
        doc, b = ngrams(texts, s.bits)
        return np.bincount(doc, held.value[b], len(texts))

    return docs.withColumn("log_weight", text_udf(log_weight, "float64")(F.col(text)))


def gumbel_keys(weighed: DataFrame, seed: int) -> DataFrame:
    """weighed and a long column gumbel_key: log weight plus standard Gumbel noise, in units of 2^-20."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return weighed.withColumn("gumbel_key", F.round((F.col("log_weight") - F.log(-F.log(u))) * float(1 << 20)).cast("long"))


def selection(keyed: DataFrame, s: Settings = Settings()):
    """The condition under which a row of `keyed` (doc_id, log_weight, gumbel_key) is among the top k.

    Among rows that tie at the k-th key the smallest ids are taken.
    """
    rows, good = keyed.agg(F.count("*"), F.count_if(F.col("log_weight") >= -math.log(s.odds))).first()
    k = good if s.keep is None else round(rows * s.keep)
    cutoff = kth_largest(keyed, "gumbel_key", k)
    if cutoff is None:
        return F.lit(False)
    key, above = cutoff
    ties = keyed.where(F.col("gumbel_key") == key).select((-F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).alias("order"))
    last, _ = kth_largest(ties, "order", k - above)
    return (F.col("gumbel_key") > key) | ((F.col("gumbel_key") == key) & (-F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) >= last))


def resample(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), keyed_table=cut) -> DataFrame:
    """docs and the columns log_weight, gumbel_key and selected; keyed_table cuts the lineage of the weighed rows."""
    ratio = fit(docs, labels, s)
    keyed = keyed_table(gumbel_keys(weigh(docs, ratio, s), s.seed))
    return keyed.withColumn("selected", selection(keyed, s))
