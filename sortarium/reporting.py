"""What the command line shows: ordered DataFrames, and a plain formatter for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortarium.taxonomy import Taxonomy, with_names


def institutions(taxonomy: Taxonomy, spark) -> DataFrame:
    return taxonomy.dimension(spark).orderBy("ord").select("institution_id", "name_ar", "name_en")


def routing(predictions: DataFrame, taxonomy: Taxonomy, limit: int = 40) -> DataFrame:
    named = with_names(predictions, taxonomy.dimension(predictions.sparkSession), "institution_id", "institution", taxonomy.fallback_id)
    return named.select("doc_id", "institution", F.round("confidence", 2).alias("confidence"), F.when(F.col("needs_review"), "review").otherwise("auto").alias("route")).orderBy("doc_id").limit(limit)


def per_class(classes: DataFrame) -> DataFrame:
    return classes.where("support > 0").orderBy("f1", "institution_id").select("institution_id", "precision", "recall", "f1", "support")


def reliability(bins: DataFrame) -> DataFrame:
    return bins.orderBy("low").withColumn("flag", F.when(F.abs("gap") < 0.1, "ok").otherwise("off"))


def sweep(points: DataFrame, target: float | None = None) -> DataFrame:
    """Points with a mark at the recommended and at the cheapest one; an accuracy without routes shows as a dash."""
    from sortarium.operators import threshold

    cheapest = threshold.recommend_min_cost(points).select("threshold", F.lit("cheapest").alias("mark"))
    marks = cheapest if target is None else cheapest.unionByName(threshold.recommend_for_target(points, target).select("threshold", F.lit("target").alias("mark")))
    marks = marks.groupBy("threshold").agg(F.array_join(F.array_sort(F.collect_set("mark")), ", ").alias("mark"))
    shown = F.when(F.col("auto_routed") > 0, F.format_string("%.3f", "auto_accuracy")).otherwise("—")
    return points.join(F.broadcast(marks), "threshold", "left").orderBy("threshold").select("threshold", "coverage", shown.alias("auto_accuracy"), "misrouted", "held", "expected_cost", F.coalesce("mark", F.lit("")).alias("mark"))


def class_thresholds(rows: DataFrame) -> DataFrame:
    return rows.orderBy("ord").select("institution_id", F.when(F.col("threshold").isNotNull(), F.format_string("%.2f", "threshold")).otherwise("—").alias("threshold"), "coverage", "auto_accuracy", "support", F.when(F.col("thin"), "thin").otherwise("").alias("note"))


def coverage(rows: DataFrame) -> DataFrame:
    return rows.orderBy("ord").select("institution_id", "have", "need")


def examples(rows: DataFrame) -> DataFrame:
    return rows.orderBy("label", "doc_id").select("doc_id", "label", F.coalesce("corrected_from", F.lit("")).alias("corrected_from"), F.length("text").alias("chars"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """(text, label, hard): documents, labels, hard ones, whole mean length."""
    return docs.agg(F.count("*").alias("documents"), F.countDistinct("label").alias("labels"), F.count_if("hard").alias("hard"), F.floor(F.sum(F.length("text")) / F.count("*")).cast("long").alias("mean_length"))


def summary(report: dict, pair_errors: list[tuple[str, int]] = ()) -> str:
    """A report as a few lines of text; pairs without errors are left out."""
    lines = [
        f"accuracy {report['accuracy']:.1%} ({report['correct']}/{report['total']}), macro F1 {report.get('macro_f1', 0):.3f}",
        f"routed {report['auto_routed']} at {report['auto_accuracy']:.1%}, held {report['held']} of which {report['held_correct']} right",
        f"mean confidence {report['mean_confidence_correct']:.2f} when right, {report['mean_confidence_wrong']:.2f} when wrong",
    ]
    lines += [f"  {pair}: {n}" for pair, n in sorted(pair_errors, key=lambda x: (-x[1], x[0])) if n]
    return "\n".join(lines)


def formatted(df: DataFrame, limit: int = 100) -> str:
    """The first rows as aligned text, and a last line if there are more."""
    found = df.limit(limit + 1).collect()
    rows = [df.columns] + [["" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in found[:limit]]
    wide = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    more = [f"(only the first {limit} rows are shown)"] if len(found) > limit else []
    return "\n".join(["  ".join(v.ljust(w) for v, w in zip(r, wide)).rstrip() for r in rows] + more)


def corpus_viewer(docs: DataFrame, limit: int = 5000, after: str | None = None) -> str:
    """A page that shows a corpus and filters it by label, difficulty, pair and term; data is escaped, never markup.

    docs is (doc_id, text, label, difficulty[, pair]). A page holds `limit` rows, by id, and says how many there are; the
    next page begins after the last id of this one.
    """
    import html
    import json

    pair = F.col("pair") if "pair" in docs.columns else F.lit(None).cast("string")
    rows = [r.asDict() for r in docs.select("doc_id", "text", "label", "difficulty", pair.alias("pair")).where(F.lit(True) if after is None else F.col("doc_id") > after).orderBy("doc_id").limit(limit).collect()]
    data = json.dumps(rows, ensure_ascii=False).replace("<", "\\u003c")
    stats = corpus_stats(docs.select("text", "label", (F.col("difficulty") == "hard").alias("hard"))).first().asDict()
    shown = html.escape(json.dumps(stats | {"shown": len(rows)}))
    filters = "".join(f"<input id={i} placeholder={name}>" for i, name in (("q", "term"), ("l", "label"), ("d", "difficulty"), ("p", "pair")))
    return (
        f"<!doctype html><meta charset=utf-8><title>corpus</title><p>{shown}</p>{filters}<div id=o></div>"
        f"<script>const D={data},v=i=>document.getElementById(i).value,o=document.getElementById('o'),same=(i,x)=>!v(i)||x===v(i);"
        "function show(){o.textContent='';for(const r of D)if((r.text||'').includes(v('q'))&&same('l',r.label)&&same('d',r.difficulty)&&same('p',r.pair))"
        "{const p=document.createElement('pre');p.textContent=`${r.doc_id} [${r.label}]\\n${r.text}`;o.append(p)}}"
        "for(const i of ['q','l','d','p'])document.getElementById(i).oninput=show;show()</script>"
    )
