"""Row types of the engine's tables; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCES = ("digital", "ocr", "mock", "plain")
STATUSES = ("labeled", "skipped", "unclear")
LANES = ("priority", "random")

DOCUMENT = "doc_id string, text string, source string, path string, page_count int, true_label string"
ALTERNATIVES = "array<struct<institution_id: string, confidence: double>>"
PREDICTION = f"doc_id string, institution_id string, confidence double, rationale_ar string, alternatives {ALTERNATIVES}, needs_review boolean, backend string"
LABEL = "doc_id string, label string, status string, lane string, model_label string, model_confidence double, model_backend string, reviewer string, reviewed_at string, seconds_spent double, notes string, path string, seq long"
QUEUE_ITEM = "doc_id string, text string, lane string, score double, reasons array<string>, model_label string, model_confidence double, model_backend string, model_rationale_ar string, alternatives array<string>, baseline_label string, path string, source string"
EXAMPLE = "doc_id string, label string, text string, corrected_from string, redacted boolean, truncated boolean"


def must(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, failing when it runs on any row for which the condition is not true."""
    return df.where(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def document_defaults(df: DataFrame) -> DataFrame:
    """Missing optional fields of documents filled in; unknown sources fail."""
    df = df.withColumns({"source": F.coalesce("source", F.lit("plain")), "page_count": F.coalesce("page_count", F.lit(1))})
    return must(df, F.col("source").isin(*SOURCES), "unknown source of a document")


def prediction_defaults(df: DataFrame) -> DataFrame:
    df = df.withColumns(
        {
            "rationale_ar": F.coalesce("rationale_ar", F.lit("")),
            "alternatives": F.coalesce("alternatives", F.array().cast(ALTERNATIVES)),
            "needs_review": F.coalesce("needs_review", F.lit(False)),
            "backend": F.coalesce("backend", F.lit("unknown")),
        }
    )
    return must(df, F.col("confidence").between(0, 1), "confidence outside 0..1")


def last_of_each(df: DataFrame, key: str = "doc_id", order: str | None = None) -> DataFrame:
    """The last row of each key, by an order column or else as the rows are read; a hash aggregation, not a sort."""
    row = F.struct(*[c for c in df.columns if c != key])
    numbered = df.withColumn("_seq", F.col(order) if order else F.monotonically_increasing_id())
    return numbered.groupBy(key).agg(F.max_by(row, "_seq").alias("_row")).select(key, "_row.*")
