"""The registered queries of this subpackage, one for each operator and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortarium.llm import bpe, fim, licenses, mixing, neardup, periodic, quality, suffixes, tiff, toolcalls, topk, toxicity, urlfilter
from sortarium.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, selected of every document: the Gumbel top-k sample towards texts labelled good."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.resample(docs.select("doc_id", "text"), labels, keyed_table=lambda df: quality.cut(df.drop("text")))
    return out.select("doc_id", "log_weight", "selected")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; only rows that aren't held out teach."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a tool call of every conversation: link, level, validation and the digest of its canonical JSON."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = toolcalls.linked(toolcalls.as_tool_messages(turns), toolcalls.tools_table(spark))
    return out.withColumn("canonical_sha256", F.sha2("canonical", 256)).drop("canonical")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the five best of every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, fetched, lists, blocked of every page; the day of fetching follows from the id, for pages hold none."""
    day = F.expr("date_add(DATE'2024-01-01', CAST(pmod(page_id * 7919, 366) AS INT))").cast("string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetched", day)
    return urlfilter.filtered(pages, urlfilter.log_table(spark)).drop("url")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, base phrases and license labels of every document."""
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded again."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, mix_epoch, mix_tokens of every document taken, once for each epoch that takes it."""
    out = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), mixing.MIX)
    return out.select("doc_id", F.coalesce(mixing.domain_of_source(), F.lit("unknown")).alias("domain"), "lang", "source", "mix_epoch", "mix_tokens")


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a TIFF file and read back: sizes, checksums and a feature string."""
    return tiff.digests(table(spark, sf_dir, "documents"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id of every document with an id: near duplicates share the least id among them."""
    return neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in every document, some of which have a repeated tail planted, and digests of what stays."""
    return periodic.digests(table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and put together for filling in the middle, and restored again."""
    return fim.digests(table(spark, sf_dir, "documents"))


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that strings of 100 bytes with an earlier start cover, and the digest of the rest."""
    return suffixes.digests(table(spark, sf_dir, "documents"))


QUERIES = {"op1_quality": op1_quality, "op2_toxicity": op2_toxicity, "op3_toolcalls": op3_toolcalls, "op4_topk": op4_topk, "op5_urlfilter": op5_urlfilter, "op6_licenses": op6_licenses, "op7_bpe": op7_bpe, "op8_mixing": op8_mixing, "op9_tiff": op9_tiff, "op10_neardup": op10_neardup, "op11_periodic": op11_periodic, "op12_fim": op12_fim, "op13_suffixes": op13_suffixes}
ORACLE_SQL: dict[str, str] = {"op3_toolcalls": toolcalls.ORACLE_SQL, "op4_topk": topk.ORACLE_SQL, "op5_urlfilter": urlfilter.ORACLE_SQL, "op8_mixing": mixing.oracle_sql()}
