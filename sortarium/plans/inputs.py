"""The engine's tables made of the driver's: truth, predictions and a label log by rule, the same in every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortarium.taxonomy import Institution, Taxonomy

RING = {"de": "en", "en": "es", "es": "fr", "fr": "de"}
TAXONOMY = Taxonomy(tuple(Institution(i, name_ar=i, name_en=i) for i in ("de", "en", "es", "fr")), (("es", "fr"), ("de", "en")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def next_of(column: str):
    out = F.lit(None).cast("string")
    for a, b in RING.items():
        out = F.when(F.col(column) == a, F.lit(b)).otherwise(out)
    return out


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("gold"))


def predictions(spark: SparkSession, sf_dir: str, threshold: float = 0.55) -> DataFrame:
    """(doc_id, institution_id, pm, confidence, alternatives, needs_review, backend): confidence pm / 1000 tracks correctness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("truth"))
    pm, r = (F.col("doc_id") * 7919 + 17) % 1001, (F.col("doc_id") * 389 + 7) % 1001
    df = docs.withColumns({"pm": pm.cast("int"), "confidence": pm / F.lit(1000.0)}).withColumn("institution_id", F.when(r <= F.col("pm"), F.col("truth")).otherwise(next_of("truth")))
    other = F.when(F.col("institution_id") == F.col("truth"), next_of("truth")).otherwise(F.col("truth"))
    second = (F.lit(1000) - F.col("pm")) / F.lit(2000.0)
    return df.select("doc_id", "institution_id", "pm", "confidence", F.array(F.struct(other.alias("institution_id"), second.alias("confidence"))).alias("alternatives"), (F.col("confidence") < threshold).alias("needs_review"), F.lit("synthetic").alias("backend"), F.lit("").alias("rationale_ar"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions beside their truth. Both come from one scan, so nothing is shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("gold"))
    pm, r = (F.col("doc_id") * 7919 + 17) % 1001, (F.col("doc_id") * 389 + 7) % 1001
    df = docs.withColumns({"pm": pm.cast("int"), "confidence": pm / F.lit(1000.0)}).withColumn("institution_id", F.when(r <= F.col("pm"), F.col("gold")).otherwise(next_of("gold")))
    return df.withColumns({"needs_review": F.col("confidence") < 0.55, "hit": (F.col("gold") == F.col("institution_id")).cast("int"), "backend": F.lit("synthetic")})


def label_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The events, of the table or a stream, as a label log: a user's id stands for the document, the type of event for the decision."""
    e = table(spark, sf_dir, "events") if events is None else events
    kind = F.col("event_type")
    langs = F.array(*map(F.lit, TAXONOMY.ids))
    pick = lambda c: F.element_at(langs, (F.pmod(c, F.lit(4)) + 1).cast("int"))
    return e.select(
        F.col("user_id").alias("doc_id"),
        F.when(kind == "error", "").otherwise(pick(F.col("event_id") * 7)).alias("label"),
        F.when(kind == "error", "skipped").when(kind == "click", "unclear").otherwise("labeled").alias("status"),
        F.when(F.col("event_id") % 3 == 0, "random").otherwise("priority").alias("lane"),
        F.when(F.col("event_id") % 5 != 0, pick(F.col("event_id") * 7 + F.when(F.col("event_id") % 4 == 1, 1).otherwise(0))).alias("model_label"),
        F.col("value").alias("seconds_spent"),
        F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("reviewer"),
        F.struct("ts", "event_id").alias("seq"),
    )


#: The same in DuckDB SQL, as common table expressions.
SQL = """
base AS (SELECT doc_id, lang AS gold, CAST((doc_id * 7919 + 17) % 1001 AS INTEGER) AS pm, (doc_id * 389 + 7) % 1001 AS r FROM documents),
ring AS (SELECT *, CASE gold WHEN 'de' THEN 'en' WHEN 'en' THEN 'es' WHEN 'es' THEN 'fr' WHEN 'fr' THEN 'de' END AS nxt FROM base),
scored AS (SELECT doc_id, gold, pm, CAST(pm AS DOUBLE) / 1000 AS confidence, CASE WHEN r <= pm THEN gold ELSE nxt END AS pred,
  CASE WHEN r <= pm THEN nxt ELSE gold END AS alt, CAST(1000 - pm AS DOUBLE) / 2000 AS alt_confidence,
  CASE WHEN r <= pm THEN 1 ELSE 0 END AS hit, CAST(pm AS DOUBLE) / 1000 < CAST(0.55 AS DOUBLE) AS needs_review FROM ring),
tax(institution_id, ord) AS (VALUES ('de', 0), ('en', 1), ('es', 2), ('fr', 3)),
pairs(a, b) AS (VALUES ('es', 'fr'), ('de', 'en')),
grid AS (SELECT CAST(k * 5 AS DOUBLE) / 100 AS threshold FROM range(21) t(k)),
log AS (SELECT user_id AS doc_id, CASE WHEN event_type = 'error' THEN '' ELSE ['de', 'en', 'es', 'fr'][CAST(event_id * 7 % 4 + 1 AS BIGINT)] END AS label,
  CASE event_type WHEN 'error' THEN 'skipped' WHEN 'click' THEN 'unclear' ELSE 'labeled' END AS status,
  CASE WHEN event_id % 3 = 0 THEN 'random' ELSE 'priority' END AS lane,
  CASE WHEN event_id % 5 <> 0 THEN ['de', 'en', 'es', 'fr'][CAST((event_id * 7 + CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END) % 4 + 1 AS BIGINT)] END AS model_label,
  value AS seconds_spent, 'r' || (event_id % 3) AS reviewer, ts, event_id FROM events),
now AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) = 1)
"""
