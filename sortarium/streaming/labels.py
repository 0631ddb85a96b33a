"""The label store as a stream: the log is read once, and each document's standing decision lives in keyed state.

Every change of a standing decision leaves as one row, with what stood before; counts by lane are sums over these rows, so
the log is never folded anew. A record that arrives after a newer one of its document changes nothing, however the log was
cut into micro-batches. Decisions stand for good, so state has no timeout; it holds a few fields a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from sortarium import schemas
from sortarium.operators.evaluate import ratio
from sortarium.operators.labels import wilson

#: What state holds of a document, and what its change says about the decision before.
_HELD = ("status", "label", "lane", "model_label")
STATE = "seq long, status string, label string, lane string, model_label string"
CHANGE = "doc_id string, seq long, status string, label string, lane string, model_label string, reviewer string, seconds_spent double, was_status string, was_label string, was_lane string, was_model_label string"


def log(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The records in a folder of JSON lines as they arrive; seq is their order."""
    return spark.readStream.schema(schemas.LABEL).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def changes(records: DataFrame) -> DataFrame:
    """Rows of CHANGE from a stream of (doc_id, seq, status, label, lane, model_label, reviewer, seconds_spent).

    Of one document's records in a micro-batch the newest counts; of records with equal seq the first to arrive. Records
    without doc_id or seq are no decisions.
    """

    def newest(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else (None,) * (1 + len(_HELD))
        best = None
        for batch in batches:
            row = batch.loc[batch.seq.idxmax()]
            if best is None or row.seq > best.seq:
                best = row
        if best is None or before[0] is not None and best.seq <= before[0]:
            return
        none = lambda v: None if v is None or v != v else v
        held = tuple(none(best[c]) for c in _HELD)
        state.update((int(best.seq), *held))
        row = (key[0], int(best.seq), *held, none(best.reviewer), none(best.seconds_spent), *before[1:])
        yield pd.DataFrame([row], columns=[c.split()[0] for c in CHANGE.split(", ")])

    known = records.where("doc_id IS NOT NULL AND seq IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "seq", *_HELD, "reviewer", "seconds_spent")
    return known.groupBy("doc_id").applyInPandasWithState(newest, CHANGE, STATE, "append", "NoTimeout")


def run(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Changes in Parquet files at out, each once, until all that is there has been read; goes on from its checkpoint."""
    return changes(records).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(changed: DataFrame) -> DataFrame:
    """The standing decision of every document."""
    row = F.struct("seq", *_HELD, "reviewer", "seconds_spent")
    return changed.groupBy("doc_id").agg(F.max_by(row, "seq").alias("r")).select("doc_id", "r.*")


def lanes(changed: DataFrame) -> DataFrame:
    """Per lane of labelled documents with a model label: n, agreed, agreement and its interval, from changes alone."""
    new = F.struct(F.lit(1).alias("by"), *(F.col(c).alias(c) for c in _HELD))
    old = F.struct(F.lit(-1).alias("by"), *(F.col(f"was_{c}").alias(c) for c in _HELD))
    moves = changed.select(F.explode(F.array(new, old)).alias("m")).select("m.*").where("status = 'labeled' AND label <> '' AND model_label IS NOT NULL")
    out = moves.groupBy("lane").agg(F.sum("by").alias("n"), F.coalesce(F.sum(F.when(F.col("label") == F.col("model_label"), F.col("by"))), F.lit(0)).alias("agreed")).where("n > 0")
    low, high = wilson(F.col("agreed"), F.col("n"))
    return out.select("lane", "n", "agreed", ratio(F.col("agreed"), F.col("n")).alias("agreement"), low.alias("low"), high.alias("high"))
