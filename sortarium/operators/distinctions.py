"""Rules that tell two often confused institutions apart, derived from labelled texts.

For each declared pair words are weighed by their log-odds between the two institutions' texts, with all texts as an
informative prior: z is the difference of the log-odds over its standard deviation. The words with the highest z on either
side, in at least `support` texts of it, are the pair's rule. What both sides use alike, or only a few texts do, has a z near 0.
"""

from __future__ import annotations

import dataclasses
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortarium import session
from sortarium.functions import text as T
from sortarium.operators import vectors
from sortarium.taxonomy import Taxonomy

#: Counts that the prior is worth, spread over the words as all texts use them.
PRIOR = 500.0
#: Distinct words of a task's counts, beyond which it hands them on.
HELD = 300_000


def word_counts(gold: DataFrame, words: int = 1) -> DataFrame:
    """(label, gram, n, texts) over gold (label, text): occurrences of each word, or run of up to `words` of them, and texts that have it.

    Tasks send sums by label, not occurrences.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[str, Counter] = defaultdict(Counter)
        held: dict[str, Counter] = defaultdict(Counter)

        def handed_on() -> Iterator[pa.RecordBatch]:
            for label, found in times.items():
                names = list(found)
                columns = [[label] * len(names), names, [found[g] for g in names], [held[label][g] for g in names]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["label", "gram", "n", "texts"])
            times.clear()
            held.clear()

        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
                found = vectors.word_gram_list(T.aggressive_text(text.as_py()), words)
                times[label].update(found)
                held[label].update(set(found))
                if sum(map(len, times.values())) > HELD:
                    yield from handed_on()
        yield from handed_on()

    some = gold.select(F.col("label").cast("string").alias("label"), "text").mapInArrow(counts, "label string, gram string, n long, texts long")
    return some.groupBy("label", "gram").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def distinctions(gold: DataFrame, pairs: DataFrame, top: int = 6, support: int = 2, words: int = 1, prior: float = PRIOR) -> DataFrame:
    """(a, b, label, place, gram, z): for both sides of each pair its `top` words, the strongest first.

    Rows without a label or text teach nothing. The result has at most 2 * top rows a pair, and is worked out at once: the counts
    are read several times, so they are stored meanwhile.
    """
    with session.stored(word_counts(gold.where("label IS NOT NULL AND text IS NOT NULL"), words)) as counts:
        rows = _told(counts, pairs, top, support, prior).collect()
    return gold.sparkSession.createDataFrame(rows, "a string, b string, label string, place int, gram string, z double")


def _told(counts: DataFrame, pairs: DataFrame, top: int, support: int, prior: float) -> DataFrame:
    sizes = counts.groupBy("label").agg(F.sum("n").alias("size"))
    everywhere = counts.groupBy("gram").agg(F.sum("n").alias("all"))
    whole = F.broadcast(counts.agg(F.sum("n").alias("total")))
    # pairs and their sizes are as many rows as the catalogue declares
    both = pairs.select("a", "b").distinct().join(F.broadcast(sizes.toDF("a", "size_a")), "a").join(F.broadcast(sizes.toDF("b", "size_b")), "b")
    sides = both.select("*", F.explode(F.array("a", "b")).alias("label"))
    of = lambda column, side: F.max(F.when(F.col("label") == F.col(side), F.col(column))).alias(f"{column}_{side}")
    met = counts.join(F.broadcast(sides), "label").groupBy("a", "b", "size_a", "size_b", "gram").agg(of("n", "a"), of("n", "b"), of("texts", "a"), of("texts", "b"))
    met = met.na.fill(0, ["n_a", "n_b", "texts_a", "texts_b"]).join(everywhere, "gram").crossJoin(whole)
    alpha = F.lit(float(prior)) * F.col("all") / F.col("total")
    odds: dict[str, Column] = {s: F.log((F.col(f"n_{s}") + alpha) / (F.col(f"size_{s}") + F.lit(float(prior)) - F.col(f"n_{s}") - alpha)) for s in "ab"}
    z = (odds["a"] - odds["b"]) / F.sqrt(1 / (F.col("n_a") + alpha) + 1 / (F.col("n_b") + alpha))
    weighed = met.select("a", "b", "gram", "texts_a", "texts_b", z.alias("z"))
    enough = weighed.where(F.when(F.col("z") > 0, F.col("texts_a") >= support).otherwise((F.col("z") < 0) & (F.col("texts_b") >= support)))
    told = enough.select("a", "b", F.when(F.col("z") > 0, F.col("a")).otherwise(F.col("b")).alias("label"), "gram", F.abs("z").alias("z"))
    place = F.row_number().over(Window.partitionBy("a", "b", "label").orderBy(F.desc(F.round("z", 9)), "gram"))
    return told.withColumn("place", place).where(F.col("place") <= top).select("a", "b", "label", "place", "gram", "z")


def ruled(taxonomy: Taxonomy, found: DataFrame) -> Taxonomy:
    """The catalogue with a rule for every institution that distinctions() found words for; rules that are written by hand stay."""
    said: dict[str, list[str]] = {}
    by_side: dict[tuple[str, str, str], list[str]] = {}
    for r in found.orderBy("a", "b", "label", "place").collect():
        by_side.setdefault((r.a, r.b, r.label), []).append(r.gram)
    for a, b in taxonomy.confusion_pairs:
        for mine, other in ((a, b), (b, a)):
            if words := by_side.get((a, b, mine)):
                said.setdefault(mine, []).append(f"إزاء {taxonomy.name_ar(other)} ترجّحها مفردات مثل «{'»، «'.join(words)}»")
    fill = lambda i: i if i.disambiguation_ar or i.id not in said else dataclasses.replace(i, disambiguation_ar="؛ ".join(said[i.id]) + ".")
    return dataclasses.replace(taxonomy, institutions=tuple(map(fill, taxonomy.institutions)))
