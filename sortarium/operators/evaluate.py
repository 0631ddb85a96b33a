"""How well predictions match the truth: one scored table, and every report as an aggregate of it.

Truth is (doc_id, gold); a document's last row counts, and empty or null labels count as unlabelled.
Duplicate predictions are each scored. Sums are of whole numbers and divided once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortarium.schemas import last_of_each


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def truth_of(docs: DataFrame, label: str = "true_label", order: str | None = None) -> DataFrame:
    """(doc_id, gold) of labelled documents; a document's last row counts, by an order column or as the rows are read."""
    rows = docs.where(F.col(label).isNotNull() & (F.col(label) != "")).select("doc_id", F.col(label).alias("gold"), *([order] if order else []))
    return last_of_each(rows, "doc_id", order).select("doc_id", "gold")


def scored(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """predictions of labelled documents with gold and hit (1 or 0)."""
    return predictions.join(truth, "doc_id").withColumn("hit", (F.col("gold") == F.col("institution_id")).cast("int"))


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no prediction belongs to a labelled document")
    return df


def summary(rows: DataFrame, micro: str = "confidence") -> DataFrame:
    """One row over scored rows: accuracy, what was routed and held by the stored flag, mean confidences."""
    auto, hit = ~F.col("needs_review"), F.col("hit") == 1
    n = lambda c: F.count_if(c)
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col(micro))), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("total"),
        n(hit).alias("correct"),
        ratio(n(hit), F.count("*")).alias("accuracy"),
        n(auto).alias("auto_routed"),
        ratio(n(auto & hit), n(auto)).alias("auto_accuracy"),
        n(~auto).alias("held"),
        n(~auto & hit).alias("held_correct"),
        mean(hit).alias("mean_confidence_correct"),
        mean(~hit).alias("mean_confidence_wrong"),
    )


def per_class(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """tp, fp, fn, support, precision, recall, f1 of every institution of the catalogue, zeros where it is absent."""
    sides = rows.select(F.explode(F.array(F.struct(F.col("gold").alias("institution_id"), F.lit(1).alias("g"), F.lit(0).alias("p"), "hit"), F.struct("institution_id", F.lit(0).alias("g"), F.lit(1).alias("p"), "hit"))).alias("s")).select("s.*")
    n = sides.groupBy("institution_id").agg(F.sum(F.col("g") * F.col("hit")).alias("tp"), F.sum(F.col("p") * (1 - F.col("hit"))).alias("fp"), F.sum(F.col("g") * (1 - F.col("hit"))).alias("fn"), F.sum("g").alias("support"))
    m = dimension.select("institution_id", "ord").join(n, "institution_id", "left").fillna(0, ["tp", "fp", "fn", "support"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    m = m.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return m.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))


def macro_f1(classes: DataFrame) -> DataFrame:
    return classes.where("support > 0").agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def confusion(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(gold, predicted, n), with a zero for both directions of every declared pair."""
    counted = rows.groupBy("gold", F.col("institution_id").alias("predicted")).agg(F.count("*").alias("n"))
    zero = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("gold"), F.col("b").alias("predicted")), F.struct(F.col("b").alias("gold"), F.col("a").alias("predicted")))).alias("c")).select("c.*", F.lit(0).cast("long").alias("n"))
    return counted.unionByName(zero).groupBy("gold", "predicted").agg(F.sum("n").alias("n"))


def confusion_map(cells: DataFrame) -> DataFrame:
    """One row: map<gold, map<predicted, n>>."""
    rows = cells.groupBy("gold").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicted", "n")))).alias("row"))
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("gold", F.to_json("row"))))).alias("confusion"))


def pair_errors(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, errors) of every declared pair, 'a <-> b'."""
    c = cells.select("gold", "predicted", "n")
    hit = ((F.col("gold") == F.col("a")) & (F.col("predicted") == F.col("b"))) | ((F.col("gold") == F.col("b")) & (F.col("predicted") == F.col("a")))
    both = c.withColumns({"lo": F.least("gold", "predicted"), "hi": F.greatest("gold", "predicted")}).join(F.broadcast(pairs), ["lo", "hi"], "right").where(hit | F.col("gold").isNull())
    return both.groupBy(F.concat_ws(" <-> ", "a", "b").alias("pair")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("errors"))


def first_backend(rows: DataFrame, order: str) -> DataFrame:
    return rows.agg(F.min_by("backend", order).alias("backend"))


def misroutes(rows: DataFrame, top: int | None = None) -> DataFrame:
    """(gold, predicted, n) of wrong routes, most frequent first."""
    wrong = rows.where("hit = 0").groupBy("gold", F.col("institution_id").alias("predicted")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gold", "predicted")
    return wrong.limit(top) if top else wrong


def mismatch(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """labelled, predicted and scored rows, to see what the report leaves out."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(truth, "labelled").crossJoin(n(predictions, "predicted")).crossJoin(n(scored(truth, predictions), "scored"))


def compare_runs(runs: DataFrame) -> DataFrame:
    """Per tag of (tag, gold, pred, hard, error): scored rows, accuracy, the same over hard ones, errors."""
    ok = F.col("error").isNull()
    hit, hard = ok & (F.col("gold") == F.col("pred")), ok & F.col("hard")
    return runs.groupBy("tag").agg(
        F.count_if(ok).alias("n"), ratio(F.count_if(hit), F.count_if(ok)).alias("accuracy"), F.count_if(hard).alias("n_hard"), ratio(F.count_if(hard & hit), F.count_if(hard)).alias("hard_accuracy"), F.count_if(~ok).alias("errors")
    )


def difficulty(model, train: DataFrame, sets: dict[str, DataFrame], dimension: DataFrame) -> DataFrame:
    """(set, total, accuracy, macro_f1) of a model fitted to train (doc_id, text, true_label) on each labelled set, in their order."""
    fitted, out = model.fit(train), None
    for k, (name, docs) in enumerate(sets.items()):
        rows = scored(truth_of(docs), fitted.predict(docs))
        one = summary(rows).crossJoin(macro_f1(per_class(rows, dimension))).select(F.lit(k).alias("k"), F.lit(name).alias("set"), "total", "accuracy", "macro_f1")
        out = one if out is None else out.unionByName(one)
    return out.orderBy("k").drop("k")
