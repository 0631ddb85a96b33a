"""Connected components of a table of links, without collecting them.

Rows with a null end are ignored; repeated links and links of a node to itself change nothing, an empty
table has no nodes, and further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortarium.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, class) of every node of links (a, b): class is the least node that it is linked to.

    Every round gives each node the least label around it and then its label's own label, so the
    number of rounds grows with the logarithm of the longest path. Rounds only move pairs of longs.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL")
    both = scratch.keep(ends.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*").distinct())
    labels = scratch.keep(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("class")))
    while True:
        around = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("class").alias("near"))
        step = labels.join(around, labels.node == around.u).select("node", F.col("class").alias("was"), F.least("class", "near").alias("class"))
        root = labels.select(F.col("node").alias("root"), F.col("class").alias("up"))
        jumped = scratch.keep(step.join(root, F.col("class") == F.col("root"), "left").select("node", "was", F.least("class", F.coalesce("up", "class")).alias("class")))
        labels = jumped.select("node", "class")
        if jumped.where("was <> class").isEmpty():
            return labels
