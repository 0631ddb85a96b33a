"""Mixing sources to target weights: budgets flow down a domain-language-source tree, leaves give token prefixes.

Every node passes its token budget to its children in proportion to their weights. What a child can't
use (its leaves of positive weight, on paths of positive weight, times max_epochs) goes to its siblings,
again by weight, and only what all of them together can't use goes back to the level above. That is a
water level at each node: each child gets the smaller of its capacity and the level times its weight. A
leaf spends its budget on whole epochs of its documents and then on the longest prefix of one more
epoch that fits, each epoch in its own seeded order.

Everything is DataFrame operations. The tree is counted before it is broadcast; the row order inside a
leaf is never sorted as a whole: counts by hash prefix find the bucket where the budget ends, longer
prefixes narrow it while it holds many places, and only what is left is ordered.

Null names count as "unknown"; names without a weight get default_weight. Weights at or below zero
give nothing. Null and empty texts have no tokens and go with any prefix that reaches them; long texts
count whole. Rows with the same doc_id and leaf share a place and are taken together or not at all; a
null doc_id is a place of its own. An empty table gives no rows. Extra columns pass through, whatever
their names; mix_epoch and mix_tokens replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortarium.llm.common import Scratch, cut


def four_bytes(text: str = "text") -> Column:
    """Tokens of a text, estimated as a fourth of its bytes, rounded up."""
    return F.coalesce(F.ceil(F.octet_length(F.col(text)) / 4), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Settings:
    """levels are (name, Column) from the root to the leaves; weights map a path of names to a whole number,
    its share among its siblings.

    budget_share is the part of all available tokens that the mixture holds.
    """

    levels: tuple[tuple[str, Callable[[], Column]], ...]
    weights: dict[tuple[str, ...], int] = field(default_factory=dict)
    default_weight: int = 1
    budget_share: float = 0.5
    max_epochs: int = 2
    seed: int = 7
    bucket_digits: int = 3
    ordered_places: int = 4096
    max_broadcast_leaves: int = 100_000


def water_fill(nodes: DataFrame, parent: list[str], name: str, budget: str, keep: list[str] = ()) -> DataFrame:
    """nodes (parent, name, capacity, weight, budget) and a column grant: each one's part of its parent's budget.

    Children in order of capacity / weight fill up one after another; the first that doesn't fill sets
    the level for itself and all after it. Parts are whole tokens, rounded down.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    order = Window.partitionBy(*parent).orderBy(F.col("ratio").asc_nulls_last(), name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    filled = nodes.withColumn("ratio", ratio)
    filled = filled.withColumn("used", F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("capacity"))).over(before), F.lit(0)))
    filled = filled.withColumn("open", F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0)).over(after))
    level = (F.col(budget) - F.col("used")) / F.col("open")
    filled = filled.withColumn("level", F.first(F.when(F.col("ratio") > level, level), ignorenulls=True).over(Window.partitionBy(*parent).orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, 0)))
    grant = F.when(F.col("ratio").isNull(), F.lit(0)).when(F.col("level").isNull(), F.col("capacity")).otherwise(F.least("capacity", F.floor(F.greatest(F.col("level"), F.lit(0.0)) * F.col("weight"))))
    return filled.withColumn("grant", grant.cast("long")).drop("ratio", "used", "open", "level")


def budgets(leaves: DataFrame, s: Settings) -> DataFrame:
    """leaves (one column a level, tokens) and a column grant, the tokens that each leaf gives."""
    names = [n for n, _ in s.levels]
    spark = leaves.sparkSession
    kinds = ", ".join(f"{n} string" for n in names) + ", weight long"
    levels, below = [], leaves.select(*names, (F.col("tokens") * s.max_epochs).alias("usable"))
    for depth in range(len(names), 0, -1):
        path = names[:depth]
        rows = [(*p, *[None] * (len(names) - depth), int(w)) for p, w in s.weights.items() if len(p) == depth]
        given = spark.createDataFrame(rows, kinds).select(*path, "weight")
        nodes = below.groupBy(*path).agg(F.sum("usable").alias("capacity")).join(F.broadcast(given), path, "left").withColumn("weight", F.coalesce("weight", F.lit(s.default_weight)))
        nodes = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0)))
        levels.insert(0, nodes)
        below = nodes.withColumnRenamed("capacity", "usable")
    known = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * s.budget_share).cast("long").alias("budget"))
    for depth, nodes in enumerate(levels, 1):
        path, parent = names[:depth], names[: depth - 1]
        nodes = nodes.join(known, parent) if parent else nodes.join(F.broadcast(known))
        known = water_fill(nodes, parent, path[-1], "budget").select(*path, F.col("grant").alias("budget"))
    return leaves.join(known, names).select(*names, "tokens", F.col("budget").alias("grant"))


def mixed(docs: DataFrame, s: Settings, tokens: Column | None = None) -> DataFrame:
    """The chosen rows of docs with the columns mix_epoch (from 0) and mix_tokens, once for each epoch that takes them."""
    scratch = Scratch(docs.sparkSession)
    own = "mix__"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    names = [f"{own}{n}" for n, _ in s.levels]
    counted, key, full, rest = f"{own}:tokens", f"{own}:id", f"{own}:full", f"{own}:rest"
    rows = docs.withColumns(
        {f"{own}{n}": F.coalesce(c().cast("string"), F.lit("unknown")) for n, c in s.levels}
        | {counted: four_bytes() if tokens is None else tokens, key: F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))}
    )
    place = F.concat(F.md5(F.concat_ws(":", F.lit(str(s.seed)), F.col(full).cast("string"), F.col(key)).cast("binary")), F.lit(":"), F.col(key))
    try:
        light = scratch.keep(rows.select(*names, F.col(counted).alias("tokens"), key))
        leaves = scratch.keep(light.groupBy(*names).agg(F.sum("tokens").alias("tokens")))
        spread = F.broadcast if leaves.count() <= s.max_broadcast_leaves else (lambda df: df)
        plan = budgets(leaves, replace(s, levels=tuple(zip(names, (c for _, c in s.levels)))))
        some = F.col("tokens") > 0
        plan = scratch.keep(plan.select(*names, F.when(some, F.expr("grant div tokens")).otherwise(F.lit(0)).cast("int").alias(full), F.when(some, F.expr("grant % tokens")).otherwise(F.lit(0)).alias(rest)))
        # Where each leaf's last epoch ends: in the bucket `prefix` of places, `before` tokens being in the buckets ahead of it.
        ends, digits = plan.where(F.col(rest) > 0).withColumns({"prefix": F.lit(""), "before": F.lit(0).cast("long")}), 0
        while True:
            inside = light.join(spread(ends), names).withColumn("place", place).where(F.substring("place", 1, digits) == F.col("prefix"))
            digits += s.bucket_digits
            buckets = inside.groupBy(*names, full, rest, "before", F.substring("place", 1, digits).alias("bucket")).agg(F.sum("tokens").alias("sum"), F.approx_count_distinct("place").alias("places"))
            reached = F.col("before") + F.sum("sum").over(Window.partitionBy(*names).orderBy("bucket"))
            last = buckets.withColumn("reached", reached).where(F.col("reached") > F.col(rest)).groupBy(*names, full, rest).agg(F.min(F.struct("bucket", (F.col("reached") - F.col("sum")).alias("before"), "places")).alias("end"))
            found = scratch.keep(last.select(*names, full, rest, F.col("end.bucket").alias("prefix"), F.col("end.before").alias("before"), F.col("end.places").alias("places")))
            ends = found.drop("places")
            if digits + s.bucket_digits > 32 or (found.agg(F.max("places")).first()[0] or 0) <= s.ordered_places:
                break
        inside = light.join(spread(ends), names).withColumn("place", place).where(F.substring("place", 1, digits) == F.col("prefix"))
        inside = inside.groupBy(*names, rest, "prefix", "before", "place").agg(F.sum("tokens").alias("tokens"))
        inside = inside.withColumn("reached", F.col("before") + F.sum("tokens").over(Window.partitionBy(*names, "prefix").orderBy("place")))
        # Without a place that fits, the epoch's part ends where the bucket begins.
        stop = f"{own}:stop"
        stops = inside.groupBy(*names).agg(F.coalesce(F.max(F.when(F.col("reached") <= F.col(rest), F.col("place"))), F.first("prefix")).alias(stop))
        budget = cut(plan.join(stops, names, "left"))
    finally:
        scratch.close()
    chosen = rows.join(spread(budget), names)
    partial = (F.col(rest) > 0) & (F.col(stop).isNull() | (place <= F.col(stop)))
    times = F.col(full) + F.when(partial, F.lit(1)).otherwise(F.lit(0))
    chosen = chosen.withColumn(full, times).where(F.col(full) > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col(full) - 1)))
    return chosen.withColumn("mix_tokens", F.col(counted)).select(*[c for c in docs.columns if c not in ("mix_epoch", "mix_tokens")], "mix_epoch", "mix_tokens")


#: The tree of the registered query: sources by their number, in four domains.
def domain_of_source() -> Column:
    number = F.regexp_extract(F.col("source"), "([0-9]+)$", 1)
    # Asked first, for element_at() with a null place gives the last element.
    return F.when(F.col("source").isNull(), F.lit(None)).when(number == "", F.lit("other")).otherwise(F.element_at(F.array(*map(F.lit, ("web", "books", "forums", "reference"))), (number.cast("long") % 4 + 1).cast("int")))


LEVELS = (("domain", domain_of_source), ("lang", lambda: F.col("lang")), ("source", lambda: F.col("source")))
WEIGHTS = {("web",): 40, ("books",): 30, ("forums",): 10, ("reference",): 20, ("other",): 5} | {
    (d, lang): w for d in ("web", "books", "forums", "reference", "other") for lang, w in (("en", 50), ("de", 20), ("fr", 20), ("es", 10))
}
MIX = Settings(LEVELS, WEIGHTS, default_weight=10)


def oracle_sql(s: Settings = MIX) -> str:
    """DuckDB SQL for the rows of mixed(documents, s) over LEVELS, by the definitions and without the buckets."""
    names = [n for n, _ in s.levels]
    given = ", ".join("(" + ", ".join(f"'{x}'" for x in (*p, *[""] * (3 - len(p)))) + f", {len(p)}, {w})" for p, w in s.weights.items())
    parts = [
        """d AS (SELECT *, coalesce(CASE WHEN source IS NULL THEN 'unknown' WHEN regexp_extract(source, '([0-9]+)$', 1) = '' THEN 'other'
          ELSE ['web', 'books', 'forums', 'reference'][CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4 + 1] END, 'unknown') AS domain_,
          coalesce(lang, 'unknown') AS lang_, coalesce(source, 'unknown') AS source_,
          coalesce((strlen(text) + 3) // 4, 0) AS tokens FROM documents)""",
        f"given(domain_, lang_, source_, depth, weight) AS (VALUES {given})",
        "leaf AS (SELECT domain_, lang_, source_, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL)",
        f"known0 AS (SELECT CAST(floor(sum(tokens) * CAST({s.budget_share} AS DOUBLE)) AS BIGINT) AS budget FROM leaf)",
    ]
    parts.append(f"node4 AS (SELECT domain_, lang_, source_, tokens * {s.max_epochs} AS capacity FROM leaf)")
    for depth in range(3, 0, -1):
        own = ", ".join(f"{n}_" for n in names[:depth])
        parts.append(
            f"""node{depth} AS (SELECT {own}, coalesce(weight, {s.default_weight}) AS weight, CASE WHEN coalesce(weight, {s.default_weight}) > 0 THEN capacity ELSE 0 END AS capacity
              FROM (SELECT {own}, CAST(sum(capacity) AS BIGINT) AS capacity FROM node{depth + 1} GROUP BY ALL) LEFT JOIN (SELECT {own}, weight FROM given WHERE depth = {depth}) USING ({own}))"""
        )
    for depth in range(1, 4):
        path = [f"{n}_" for n in names[:depth]]
        parent, own = path[:-1], ", ".join(path)
        part = f"PARTITION BY {', '.join(parent)}" if parent else ""
        using = f"JOIN known{depth - 1} USING ({', '.join(parent)})" if parent else "CROSS JOIN known0"
        parts += [
            f"""fill{depth} AS (SELECT *, CASE WHEN weight > 0 THEN capacity / weight END AS ratio,
              (budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(greatest(weight, 0)) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
              FROM node{depth} {using} WINDOW w AS ({part} ORDER BY CASE WHEN weight > 0 THEN capacity / weight END NULLS LAST, {path[-1]}))""",
            f"""known{depth} AS (SELECT {own}, CASE WHEN ratio IS NULL THEN 0 WHEN reached IS NULL THEN capacity ELSE least(capacity, CAST(floor(greatest(reached, 0.0) * weight) AS BIGINT)) END AS budget
              FROM (SELECT *, first_value(CASE WHEN ratio > level THEN level END IGNORE NULLS) OVER ({part} ORDER BY ratio NULLS LAST, {path[-1]} ROWS UNBOUNDED PRECEDING) AS reached FROM fill{depth}))""",
        ]
    parts += [
        "spent AS (SELECT domain_, lang_, source_, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM leaf JOIN known3 USING (domain_, lang_, source_))",
        f"""ranked AS (SELECT *, sum(tokens) OVER (PARTITION BY domain_, lang_, source_ ORDER BY md5('{s.seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), coalesce(CAST(doc_id AS VARCHAR), 'null') RANGE UNBOUNDED PRECEDING) AS reached
          FROM d JOIN spent USING (domain_, lang_, source_))""",
        "times AS (SELECT *, whole + CASE WHEN rest > 0 AND reached <= rest THEN 1 ELSE 0 END AS n FROM ranked)",
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, domain_ AS domain, lang, source, CAST(unnest(range(n)) AS INTEGER) AS mix_epoch, CAST(tokens AS BIGINT) AS mix_tokens FROM times WHERE n > 0"
