"""Where to set the confidence gate: sweeps, recommendations, calibration, thresholds by class, a held-out check.

Thresholds form an ordered grid, so a sweep needs no row for each pair of threshold and document: rows
are counted by the largest grid point they reach, and sums over the (few) points above give the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortarium.operators.evaluate import ratio

GRID = tuple(k * 5 / 100 for k in range(21))
MISROUTE, REVIEW, TEST_RATIO, BINS, MIN_SUPPORT = 20.0, 1.0, 0.4, 10, 10


def _points(spark, grid: tuple[float, ...]) -> DataFrame:
    return spark.createDataFrame([(float(t),) for t in sorted(set(grid))], "threshold double")


def _reached(grid: tuple[float, ...], confidence: str = "confidence") -> Column:
    """The largest grid point that a confidence reaches, compared with the grid's own doubles; null below all."""
    out = F.lit(None).cast("double")
    for t in sorted(set(grid)):
        out = F.when(F.col(confidence) >= F.lit(float(t)), F.lit(float(t))).otherwise(out)
    return out


def sweep(rows: DataFrame, grid: tuple[float, ...] | None = None, misroute: float = MISROUTE, review: float = REVIEW, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a threshold (and value of `by`) over scored rows; the stored needs_review flag plays no part."""
    grid = grid or GRID
    n = rows.groupBy(*by, _reached(grid).alias("threshold")).agg(F.count("*").alias("n"), F.sum("hit").alias("right"))
    total = n.groupBy(*by).agg(F.sum("n").alias("total"), F.sum("right").alias("right_total"))
    cells = total.crossJoin(F.broadcast(_points(rows.sparkSession, grid))).join(n, [*by, "threshold"], "left")
    up = Window.partitionBy(*by).orderBy(F.desc("threshold"))
    c = cells.select(*by, "threshold", "total", "right_total", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("auto_routed"), F.coalesce(F.sum("right").over(up), F.lit(0)).alias("auto_correct"))
    c = c.withColumns({"misrouted": F.col("auto_routed") - F.col("auto_correct"), "held": F.col("total") - F.col("auto_routed"), "held_correct": F.col("right_total") - F.col("auto_correct")})
    return c.select(
        *by, "threshold", "auto_routed", ratio(F.col("auto_routed"), F.col("total")).alias("coverage"), "auto_correct", ratio(F.col("auto_correct"), F.col("auto_routed")).alias("auto_accuracy"), "misrouted", "held", "held_correct",
        (F.col("misrouted") * misroute + F.col("held") * review).alias("expected_cost"), ratio(F.col("auto_correct") + F.col("held"), F.col("total")).alias("resolved_accuracy"),
    )


def recommend_for_target(points: DataFrame, target: float) -> DataFrame:
    """The point of highest coverage, then lowest threshold, among those that route anything and reach the target; no row if none."""
    return points.where((F.col("auto_routed") > 0) & (F.col("auto_accuracy") >= target)).orderBy(F.desc("coverage"), "threshold").limit(1)


def recommend_min_cost(points: DataFrame) -> DataFrame:
    return points.orderBy("expected_cost", "threshold").limit(1)


def calibration_bins(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """Non-empty bins of confidence: low, high, n, mean_confidence, accuracy, gap."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    b = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), (F.sum("hit") / F.count("*")).alias("accuracy"))
    return b.select("bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), "n", "mean_confidence", "accuracy", (F.col("mean_confidence") - F.col("accuracy")).alias("gap"))


def verdict(ece: Column, drift: Column) -> Column:
    return F.when(ece < 0.05, "well calibrated").when(drift > 0.05, "overconfident").when(drift < -0.05, "underconfident").otherwise("poorly calibrated (non-monotonic)")


def calibration(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """One row: ece, mean_confidence, accuracy, verdict."""
    b = calibration_bins(rows, bins)
    total = F.sum("n")
    out = b.agg((F.sum(F.col("n") * F.abs("gap")) / total).alias("ece"), (F.sum(F.col("n") * F.col("mean_confidence")) / total).alias("mean_confidence"), (F.sum(F.col("n") * F.col("accuracy")) / total).alias("accuracy"))
    return out.withColumn("verdict", verdict(F.col("ece"), F.col("mean_confidence") - F.col("accuracy")))


def per_class_thresholds(rows: DataFrame, dimension: DataFrame, target: float = 0.95, grid: tuple[float, ...] | None = None, min_support: int = MIN_SUPPORT) -> DataFrame:
    """For every institution as predicted: the lowest threshold of highest coverage that reaches the target."""
    points = sweep(rows, grid, by=("institution_id",))
    best = points.where((F.col("auto_routed") > 0) & (F.col("auto_accuracy") >= target)).groupBy("institution_id").agg(F.max(F.struct("coverage", (-F.col("threshold")).alias("low"), "auto_accuracy")).alias("best"))
    support = rows.groupBy("institution_id").agg(F.count("*").alias("support"))
    out = dimension.select("institution_id", "ord").join(support, "institution_id", "left").join(best, "institution_id", "left")
    return out.select("institution_id", "ord", (-F.col("best.low")).alias("threshold"), F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"), F.coalesce("best.auto_accuracy", F.lit(0.0)).alias("auto_accuracy"), F.coalesce("support", F.lit(0)).alias("support"), (F.coalesce("support", F.lit(0)) < min_support).alias("thin"))


def split(ids: DataFrame, ratio_test: float = TEST_RATIO, order: Column | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, train): a seeded order of the ids, of which the first part trains.

    The cut is found from counts by hash range, so no single task orders all ids; exact up to ties of the hash.
    """
    key = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) if order is None else order
    rows = ids.select("doc_id", key.cast("long").alias("_key"))
    n, top = rows.agg(F.count("*"), F.max("_key")).first()
    want, lo, hi = int((n or 0) * (1 - ratio_test)), 0, (top or 0) + 1
    below = 0
    while hi - lo > 1:
        width = max(1, -(-(hi - lo) // 4096))
        counts = dict(rows.where((F.col("_key") >= lo) & (F.col("_key") < hi)).groupBy(F.expr(f"(_key - {lo}L) div {width}L").alias("b")).count().collect())
        end = hi
        for b in sorted(counts):
            if below + counts[b] > want:
                lo, end = lo + b * width, min(hi, lo + (b + 1) * width)
                break
            below += counts[b]
        else:
            lo = end = hi
        if end - lo <= 1:
            break
        hi = end
    return rows.select("doc_id", (F.col("_key") < lo).alias("train"))


def split_validate(rows: DataFrame, parts: DataFrame, target: float = 0.95, misroute: float = MISROUTE, review: float = REVIEW, mode: str = "target", grid: tuple[float, ...] | None = None) -> DataFrame:
    """Threshold chosen on the training part and measured on the other; no row if none is found or a part is empty.

    optimism is the accuracy promised less the accuracy delivered.
    """
    both = rows.join(parts, "doc_id")
    train, test = both.where("train"), both.where("NOT train")
    points = sweep(train, grid, misroute, review)
    chosen = recommend_for_target(points, target) if mode == "target" else recommend_min_cost(points)
    chosen = chosen.select("threshold", F.col("auto_accuracy").alias("train_accuracy"), F.col("coverage").alias("train_coverage"))
    cell = test.crossJoin(F.broadcast(chosen)).groupBy("threshold", "train_accuracy", "train_coverage").agg(F.count("*").alias("n_test"), F.count_if(F.col("confidence") >= F.col("threshold")).alias("auto"), F.count_if((F.col("confidence") >= F.col("threshold")) & (F.col("hit") == 1)).alias("right"))
    out = cell.select("threshold", "train_accuracy", "train_coverage", ratio(F.col("right"), F.col("auto")).alias("test_accuracy"), ratio(F.col("auto"), F.col("n_test")).alias("test_coverage"), "n_test")
    return out.withColumn("optimism", F.col("train_accuracy") - F.col("test_accuracy"))
