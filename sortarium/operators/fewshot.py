"""Few-shot examples from confirmed labels: every class first, corrections next, the rest while there is room."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sortarium.functions import text as T
from sortarium.schemas import last_of_each
from sortarium.taxonomy import Taxonomy

HEAD = "\n\nسوابق بتّ فيها موظفون، للقياس عليها متى طابق موضوعها موضوع الوثيقة (ما بين قوسين مربعين محجوب):"


def select_examples(docs: DataFrame, gold: DataFrame, model_labels: DataFrame, dimension: DataFrame, per_class: int = 1, max_examples: int = 20, max_chars: int = 700, redact: bool = True) -> DataFrame:
    """(doc_id, label, text, corrected_from, redacted, truncated), by label and id.

    gold is (doc_id, label), model_labels (doc_id, model_label). The first per_class ids of a class hold
    its places, blank documents too, which then give no example. Only the candidates that can be
    chosen, at most a few times max_examples for each class, are ranked.
    """
    known = dimension.select(F.col("institution_id").alias("label"), "ord")
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    was = last_of_each(model_labels.select("doc_id", F.col("model_label").alias("was")))
    # Choosing needs no text but whether there is one.
    rows = last_of_each(gold.select("doc_id", "label")).join(F.broadcast(known), "label").join(texts.select("doc_id", (T.strip(F.col("text")) == "").alias("blank")), "doc_id").join(was, "doc_id", "left")
    rows = rows.withColumn("agrees", F.coalesce("was", "label") == F.col("label"))
    rank = Window.partitionBy("label").orderBy("agrees", "doc_id")
    # Each class keeps its first places and as many documents with text as could ever be shown, by limits that tasks apply themselves.
    places = rows.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= per_class)
    spare = rows.where("NOT blank").withColumn("filled", F.row_number().over(rank)).where(F.col("filled") <= max_examples + per_class).drop("filled")
    first = places.where("NOT blank").withColumn("turn", F.row_number().over(Window.orderBy("ord", "place"))).where(F.col("turn") <= max_examples)
    rows = spare.withColumn("place", F.lit(None).cast("int"))
    n = first.groupBy().agg(F.count("*").alias("used"))
    others = rows.join(first.select("doc_id"), "doc_id", "left_anti")
    second = others.withColumn("turn", F.row_number().over(Window.orderBy("agrees", "label", "doc_id"))).crossJoin(F.broadcast(n)).where(F.col("turn") <= max_examples - F.col("used")).drop("used")
    chosen = texts.join(F.broadcast(first.unionByName(second)), "doc_id")
    named = chosen.join(F.broadcast(known.select(F.col("label").alias("was"), F.lit(True).alias("real"))), "was", "left")
    corrected = F.when(F.col("real") & (F.col("was") != F.col("label")) & (F.col("was") != ""), F.col("was"))
    out = named.select("doc_id", "label", T.example_text(F.col("text"), max_chars, redact).alias("text"), corrected.alias("corrected_from"), F.lit(redact).alias("redacted"), (F.length(T.strip(F.col("text"))) > max_chars).alias("truncated"))
    return out.orderBy("label", "doc_id")


def leakage(examples: DataFrame, eval_docs: DataFrame) -> DataFrame:
    """Ids that are in the prompt and in the evaluation."""
    return eval_docs.select("doc_id").distinct().join(F.broadcast(examples.select("doc_id").distinct()), "doc_id", "left_semi")


def counts(examples: DataFrame) -> DataFrame:
    return examples.groupBy("label").agg(F.count("*").alias("n"), F.count("corrected_from").alias("corrections"))


def render(examples: list, taxonomy: Taxonomy) -> str:
    """The block of a prompt that shows collected examples; '' without any."""
    shown = []
    for e in examples:
        note = f"\nتنبيه: أخطأ النموذج فيها فاختار {e['corrected_from']}." if e["corrected_from"] else ""
        shown.append(f"\n<سابقة جهة=\"{e['label']}\" اسم=\"{taxonomy.name_ar(e['label'])}\">\n{e['text']}{note}\n</سابقة>")
    return HEAD + "".join(shown) if shown else ""


def save(examples: DataFrame, path: str | Path, version: int = 1) -> Path:
    """A set of examples, bounded by max_examples, as one JSON file."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"taxonomy_version": version, "examples": [r.asDict() for r in examples.collect()]}, ensure_ascii=False, indent=2), encoding="utf-8")
    return path


def load(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))
