"""The triage as a stream: files of documents arrive, are masked, classified and gated, and leave once.

An addition: the batch functions take streaming DataFrames as they are, so this is only the plumbing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sortarium import schemas
from sortarium.functions import text as T
from sortarium.operators import classify


def documents(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    raw = spark.readStream.schema(schemas.DOCUMENT).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return raw.withColumns({"source": F.coalesce("source", F.lit("plain")), "page_count": F.coalesce("page_count", F.lit(1))})


def routed(docs: DataFrame, classifier: classify.Classifier) -> DataFrame:
    return classifier.predict(docs.withColumn("text", T.masked(F.col("text"))))


def run(docs: DataFrame, classifier: classify.Classifier, out: str, checkpoint: str) -> StreamingQuery:
    """Predictions in Parquet; a batch that is repeated after a failure is written once."""
    return routed(docs, classifier).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decisions_per_window(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """How many labels of each status came in each window of time, from a stream of (ts, status)."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"))
