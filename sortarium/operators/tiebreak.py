"""A second look at close calls between institutions that are known to be confused."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortarium.operators.classify import Classifier
from sortarium.taxonomy import Taxonomy

MAX_CONFIDENCE = 0.90

PROMPT = """انحصر الاختيار في جهتين تلتبس وثائقهما، وعليك أن ترجّح إحداهما.

[{a.id}] {a.name_ar}: {a.description_ar}
    ما يميزها: {rule_a}
[{b.id}] {b.name_ar}: {b.description_ar}
    ما يميزها: {rule_b}

حدّد أولاً الخدمة التي يلتمسها كاتب الوثيقة، ثم انظر أي الجهتين تقدّمها. المفردات المشتركة بينهما لا تصلح دليلاً، وما ينفيه الكاتب عن نفسه ليس طلباً له.

<وثيقة>
{text}
</وثيقة>

الجواب كائن JSON واحد: {{"institution_id": "{a.id}" أو "{b.id}", "confidence": رقم بين 0 و1, "rationale_ar": "سطر يذكر الخدمة الملتمسة ومن يقدّمها"}}"""


def prompt(taxonomy: Taxonomy, a: str, b: str, text: str) -> str:
    first, second = taxonomy.get(a), taxonomy.get(b)
    if first is None or second is None:
        raise ValueError("a tiebreak needs two institutions of the taxonomy")
    return PROMPT.format(a=first, b=second, rule_a=first.disambiguation_ar or "—", rule_b=second.disambiguation_ar or "—", text=text)


def partner(taxonomy: Taxonomy) -> Column:
    """The first alternative that forms a declared pair with the first choice, in either order; null without one."""
    pairs = F.array(*[F.lit(f"{min(p)}|{max(p)}") for p in taxonomy.confusion_pairs]) if taxonomy.confusion_pairs else F.array().cast("array<string>")
    first = F.col("institution_id")
    key = lambda a: F.concat_ws("|", F.least(first, a["institution_id"]), F.greatest(first, a["institution_id"]))
    found = F.filter("alternatives", lambda a: (a["institution_id"] != first) & F.array_contains(pairs, key(a)))
    return F.get(found, F.lit(0))["institution_id"]


def gated(predictions: DataFrame, taxonomy: Taxonomy, most: float = MAX_CONFIDENCE) -> DataFrame:
    """predictions with partner, and adjudicate: a partner exists and confidence is at most `most`."""
    df = predictions.withColumn("partner", partner(taxonomy))
    return df.withColumn("adjudicate", F.col("partner").isNotNull() & (F.col("confidence") <= most))


#: What decides between two institutions: text, a, b -> (institution, confidence, rationale).
Resolver = Callable[[str, str, str], tuple[str, float, str]]


class TiebreakClassifier:
    """A classifier whose close calls a resolver decides; where it fails, the first prediction stands.

    Only the id, the confidence, the rationale (if one is given) and the backend change. Only rows that
    need it go to Python.
    """

    def __init__(self, base: Classifier, resolver: Resolver, taxonomy: Taxonomy, max_confidence: float = MAX_CONFIDENCE):
        self.base, self.resolver, self.taxonomy, self.most = base, resolver, taxonomy, max_confidence
        self.name = f"tiebreak({base.name})"

    def predict(self, docs: DataFrame) -> DataFrame:
        return self.resolve(self.base.predict(docs), docs).drop("adjudicated", "changed")

    def resolve(self, predictions: DataFrame, docs: DataFrame) -> DataFrame:
        """predictions after the tiebreak, with adjudicated and changed."""
        df = gated(predictions, self.taxonomy, self.most)
        kept = df.where("NOT adjudicate").withColumns({"adjudicated": F.lit(False), "changed": F.lit(False)})
        asked = df.where("adjudicate").join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id")
        resolver, name = self.resolver, self.name

        def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for doc_id, text, a, b in zip(batch.doc_id, batch._text, batch.institution_id, batch.partner):
                    try:
                        chosen, sure, why = resolver(text, a, b)
                        ok = chosen in (a, b)
                    except Exception:  # noqa: BLE001  a resolver that fails must not take the run with it
                        ok = False
                    out.append((doc_id, chosen, min(1.0, max(0.0, float(sure))), why) if ok else (doc_id, None, None, None))
                yield pd.DataFrame(out, columns=["doc_id", "_chosen", "_sure", "_why"])

        kind = predictions.schema["doc_id"].dataType.simpleString()
        answers = asked.select("doc_id", "_text", "institution_id", "partner").mapInPandas(decide, f"doc_id {kind}, _chosen string, _sure double, _why string")
        both = asked.drop("_text").join(answers, "doc_id")
        ok = F.col("_chosen").isNotNull()
        new = both.withColumns(
            {
                "adjudicated": ok,
                "changed": ok & (F.col("_chosen") != F.col("institution_id")),
                "institution_id": F.coalesce("_chosen", "institution_id"),
                "confidence": F.coalesce("_sure", "confidence"),
                "rationale_ar": F.when(F.coalesce(F.col("_why"), F.lit("")) != "", F.col("_why")).otherwise(F.col("rationale_ar")),
                "backend": F.when(ok, F.lit(name)).otherwise(F.col("backend")),
            }
        ).drop("_chosen", "_sure", "_why")
        return kept.unionByName(new).drop("partner", "adjudicate")


def counters(resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count_if("adjudicated").alias("adjudicated"), F.count_if("changed").alias("changed"))
