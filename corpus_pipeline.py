"""The training-data pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the
columns of documents; the last returns its own. Labels are read from sf_dir.

In every stage null texts count as empty, long texts count whole, an empty table gives an empty one, and
extra columns pass through, whatever their names (the last stage leaves them out).
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortarium.llm import bpe, mixing, neardup, quality, toxicity
from sortarium.llm.common import STORED, removed, shared_dir, stored, table

TOXIC_FROM = 0.5
#: The corpus has just lost its copies, so the mixture takes no document twice.
MIX = dataclasses.replace(mixing.MIX, budget_share=0.8, max_epochs=1)
TOKENIZER = "word_bpe_49k.json"


def _beside(docs: DataFrame, added: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What stage leaves of docs, with the columns of docs; those that are named like one that stage adds go by another name there."""
    other = {c: f"own {c}" for c in docs.columns if c.lower() in added}
    left = stage(docs.withColumnsRenamed(other)).select(*[other.get(c, c) for c in docs.columns])
    return left.withColumnsRenamed({v: k for k, v in other.items()})


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC_FROM.

    Texts without words score the prior of the model. Repeated rows are judged alike. Rows with a null doc_id teach
    nothing and are judged like others. Without labels nothing is rejected: no text reaches TOXIC_FROM on its own.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    if not len(model[0]) and not model[2]:
        return docs
    return _beside(docs, ("score",), lambda d: toxicity.score(d, model).where(F.col("score") < TOXIC_FROM))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The Gumbel top-k sample towards texts labelled good.

    Repeated rows go or stay together, as do rows that tie at the k-th key with one id. Rows with a null doc_id are
    drawn like others. Without good labels every row stays.
    """
    labels = table(spark, sf_dir, "labels")
    return _beside(docs, ("log_weight", "gumbel_key", "selected"), lambda d: quality.resample(d, labels, keyed_table=stored).where("selected"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates, that with the least id.

    Of rows that repeat that id one stays. Empty texts are copies of one another. Rows with a null doc_id stay.
    """
    return neardup.deduplicated(docs)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the budgets of their sources take.

    Null langs and sources count as "unknown". Texts without tokens go with any prefix that reaches them. Rows of one
    leaf that repeat a doc_id, or have none, go or stay together.
    """
    return _beside(docs, ("mix_epoch", "mix_tokens"), lambda d: mixing.mixed(d, MIX))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids, the tokens, of every row; empty texts have none, repeated rows equal ones."""
    rows = bpe.encoded(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(TOKENIZER))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", without_toxic), ("quality", good_quality), ("near duplicates", one_of_each), ("mixing", to_target_weights), ("tokens", tokens)]

#: Signatures, learnt weights and merges have no SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote goes when the next has read it."""
    docs, made = table(spark, sf_dir, "documents"), len(STORED)
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{k}")
        for path in [*STORED[made:], *([f"{root}/{k - 1}"] if k else [])]:
            removed(spark, path)
        del STORED[made:]
    return docs
