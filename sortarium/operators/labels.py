"""The label store: an append-only log, its current state, and what it says about the reviewers' work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortarium import schemas
from sortarium.operators.evaluate import ratio


def checked(records: DataFrame, ids: list[str]) -> DataFrame:
    """Records as the store takes them: label stripped, notes cut to 2000 characters; bad status or label fails."""
    df = records.withColumns({"label": F.trim(F.coalesce("label", F.lit(""))), "notes": F.substring(F.coalesce("notes", F.lit("")), 1, 2000)})
    df = schemas.must(df, F.col("status").isin(*schemas.STATUSES), "unknown status of a label")
    return schemas.must(df, (F.col("status") != "labeled") | F.col("label").isin(*ids), "label outside the taxonomy")


def current(log: DataFrame, order: str | Column = "seq") -> DataFrame:
    """The last record of every document."""
    row = F.struct(*[c for c in log.columns if c != "doc_id"])
    return log.groupBy("doc_id").agg(F.max_by(row, order).alias("_r")).select("doc_id", "_r.*")


def gold(now: DataFrame) -> DataFrame:
    """(doc_id, label) of documents whose current record is a label."""
    return now.where("status = 'labeled' AND label <> ''").select("doc_id", "label")


def decided(now: DataFrame) -> DataFrame:
    """Ids that nobody needs to look at again; skips count."""
    return now.select("doc_id")


def wilson(agreed: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95 % interval of a share, (0, 0) without rows."""
    p, zz = agreed / n, z * z
    mid, half, den = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)), 1 + zz / n
    side = lambda v: F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / den))).otherwise(F.lit(0.0))
    return side(mid - half), side(mid + half)


def upper_median(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The element at place n div 2 of the sorted values, zeros and nulls left out, from counts of distinct values."""
    from pyspark.sql import Window

    v = rows.where(F.col(value).isNotNull() & (F.col(value) != 0)).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(value)
    v = v.withColumns({"_upto": F.sum("_n").over(w), "_all": F.sum("_n").over(Window.partitionBy(*by))})
    return v.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*by).agg(F.min(value).alias("upper_median"))


def lanes(now: DataFrame) -> DataFrame:
    """Per lane of labelled records with a model label: n, agreed, agreement and its interval."""
    rows = now.where("status = 'labeled' AND label <> '' AND model_label IS NOT NULL")
    out = rows.groupBy("lane").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("model_label")).alias("agreed"))
    low, high = wilson(F.col("agreed"), F.col("n"))
    return out.select("lane", "n", "agreed", ratio(F.col("agreed"), F.col("n")).alias("agreement"), low.alias("low"), high.alias("high"))


def stats(log: DataFrame, order: str | Column = "seq") -> DataFrame:
    """One row: records in the log, and documents by their current status."""
    now = current(log, order)
    return log.agg(F.count("*").alias("total_records")).crossJoin(now.agg(F.count("*").alias("documents"), *[F.count_if(F.col("status") == s).alias(s) for s in schemas.STATUSES]))


def per_class(now: DataFrame) -> DataFrame:
    return gold(now).groupBy("label").agg(F.count("*").alias("n"))


def reviewers(now: DataFrame) -> DataFrame:
    return now.groupBy("reviewer").agg(F.count("*").alias("n"))


def coverage(now: DataFrame, dimension: DataFrame, target: int = 25) -> DataFrame:
    """How many labels every institution has and still needs."""
    have = per_class(now).withColumnRenamed("label", "institution_id")
    out = dimension.select("institution_id", "ord").join(have, "institution_id", "left").select("institution_id", "ord", F.coalesce("n", F.lit(0)).alias("have"))
    return out.withColumn("need", F.greatest(F.lit(0), target - F.col("have")))


def exported(docs: DataFrame, now: DataFrame) -> DataFrame:
    """Documents with their confirmed label as true_label."""
    return docs.drop("true_label").join(gold(now).withColumnRenamed("label", "true_label"), "doc_id")


def missing(docs: DataFrame, now: DataFrame) -> DataFrame:
    """Confirmed ids without a document."""
    return gold(now).join(docs, "doc_id", "left_anti").select("doc_id")
