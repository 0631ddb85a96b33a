"""Mock corpora as DataFrames: rows are numbered, and hashes of the numbers choose everything, so any row can be made anywhere."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortarium.functions import text as T
from sortarium.taxonomy import Taxonomy

HARD_RATIO, NOISE_RATIO = 0.15, 0.25

#: What fills the slots of a scenario.
POOLS = {
    "city": ("الرياض", "جدة", "الدمام", "أبها", "تبوك", "حائل"),
    "district": ("النخيل", "الروضة", "السلام", "العليا"),
    "car": ("تويوتا", "هيونداي", "نيسان", "فورد"),
    "year": ("2019", "2020", "2021", "2022", "2023"),
    "date": ("1445/03/12", "1445/06/02", "1446/01/20", "1446/04/09"),
}
SCENARIOS = (
    "إلى {name}\nأرجو النظر في طلبي بشأن {topic} في مدينة {city} حي {district} بتاريخ {date}.\nرقم المعاملة {case}.",
    "السادة {name}، تحية طيبة.\nأتقدم بشكوى تخص {topic} بتاريخ {date}، والمبلغ المطالب به {amount} ريال.",
    "الموضوع: {topic}\nأفيدكم بأن عدد الحالات {count} في {city} خلال عام {year}، ونأمل من {name} اتخاذ اللازم.",
)
HARD = "إلى {name}\nمع أن الخطاب يذكر {other} فإن المطلوب هو {topic} لا غير، وذلك في {city} بتاريخ {date}."


def _draw(seed: int, n: Column, what: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), n, F.lit(what)), F.lit(1 << 40))


def _pick(values: tuple[str, ...], draw: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (draw % len(values) + 1).cast("int"))


def filled(template: Column, seed: int, n: Column) -> Column:
    """A template with its slots filled from the pools and from numbers."""
    out = template
    for slot, values in POOLS.items():
        out = F.replace(out, F.lit("{%s}" % slot), _pick(values, _draw(seed, n, slot)))
    for slot, low, high in (("amount", 500, 90_000), ("case", 100_000, 999_999), ("count", 2, 40)):
        out = F.replace(out, F.lit("{%s}" % slot), (_draw(seed, n, slot) % (high - low) + low).cast("string"))
    return out


def templates(spark: SparkSession, taxonomy: Taxonomy, n_per_class: int = 20, seed: int = 7, hard_ratio: float = HARD_RATIO, noise_ratio: float = NOISE_RATIO) -> DataFrame:
    """n_per_class plain documents of every institution, and hard ones that name a neighbour's subject, some with scan noise."""
    classes = len(taxonomy.institutions)
    plain = n_per_class * classes
    hard = int(plain * hard_ratio)
    names = F.array(*[F.lit(i.name_ar) for i in taxonomy.institutions])
    ids = F.array(*map(F.lit, taxonomy.ids))
    topics = F.array(*[F.array(*map(F.lit, i.keywords_ar or (i.id,))) for i in taxonomy.institutions])
    near = {i: [b if a == i else a for a, b in taxonomy.confusion_pairs if i in (a, b)] for i in taxonomy.ids}
    others = F.array(*[F.lit(taxonomy.get((near[i] or taxonomy.ids)[0]).name_ar) for i in taxonomy.ids])
    n = F.col("id")
    at = (F.when(n < plain, n % classes).otherwise(_draw(seed, n, "class") % classes) + 1).cast("int")
    subject = F.element_at(topics, at)
    template = F.when(n < plain, _pick(SCENARIOS, _draw(seed, n, "scenario"))).otherwise(F.lit(HARD))
    text = filled(template, seed, n)
    text = F.replace(text, F.lit("{name}"), F.element_at(names, at))
    text = F.replace(text, F.lit("{other}"), F.element_at(others, at))
    text = F.replace(text, F.lit("{topic}"), F.element_at(subject, (_draw(seed, n, "topic") % F.size(subject) + 1).cast("int")))
    noisy = _draw(seed, n, "noise") % 10_000 < int(noise_ratio * 10_000)
    rows = spark.range(plain + hard).select("id", text.alias("text"), noisy.alias("noisy"), F.element_at(ids, at).alias("true_label"))
    source = F.when(F.col("noisy"), F.lit("ocr")).otherwise(F.lit("mock"))
    return rows.select(F.format_string("mock-%06d", "id").alias("doc_id"), F.when(F.col("noisy"), T.ocr_noise(F.col("text"), F.xxhash64(F.lit(seed), "id"))).otherwise(F.col("text")).alias("text"), source.alias("source"), F.lit(None).cast("string").alias("path"), F.lit(1).alias("page_count"), "true_label")


def curated(spark: SparkSession, taxonomy: Taxonomy, folder: str, hard_only: bool = False, noise_ratio: float = NOISE_RATIO, seed: int = 7) -> DataFrame:
    """Documents of a folder's corpus_part*.json or .yaml files in order of name: id, label, difficulty, subject, text, pair."""
    entries = []
    for p in sorted(Path(folder).glob("corpus_part*")):
        raw = p.read_text(encoding="utf-8")
        if p.suffix == ".json":
            entries += json.loads(raw)
        else:
            import yaml

            found = yaml.safe_load(raw)
            entries += found if isinstance(found, list) else next(v for v in found.values() if isinstance(v, list))
    seen = [e["id"] for e in entries]
    if len(set(seen)) < len(seen):
        raise ValueError("an id occurs twice in the corpus")
    if unknown := sorted({e["label"] for e in entries} - set(taxonomy.ids)):
        raise ValueError(f"labels outside the taxonomy: {unknown}")
    if not hard_only and (missing := sorted(set(taxonomy.ids) - {e["label"] for e in entries})):
        raise ValueError(f"institutions without a document: {missing}")
    rows = [(e["id"], e["text"].strip(), e["label"], e.get("difficulty"), e.get("subject"), e.get("pair")) for e in entries if not hard_only or e.get("difficulty") == "hard"]
    df = spark.createDataFrame(rows, "doc_id string, text string, true_label string, difficulty string, subject string, pair string")
    key = F.xxhash64(F.lit(seed), "doc_id")
    noisy = F.pmod(key, F.lit(10_000)) < int(noise_ratio * 10_000)
    return df.withColumns({"source": F.when(noisy, "ocr").otherwise("mock"), "text": F.when(noisy, T.ocr_noise(F.col("text"), key)).otherwise(F.col("text"))})


def by_model(spark: SparkSession, taxonomy: Taxonomy, client, model: str, n_per_class: int = 10) -> DataFrame:
    """Documents that a model writes, one request each; replies are used as they come."""
    names = {i.id: i.name_ar for i in taxonomy.institutions}

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, client.chat(model=model, messages=[{"role": "user", "content": f"اكتب وثيقة رسمية قصيرة موجهة إلى {names[i]}. النسخة {k}."}])) for i, k in zip(batch.true_label, batch.k)]
            yield pd.DataFrame([(f"llm-{i}-{k:03d}", t, i) for i, k, t in rows], columns=["doc_id", "text", "true_label"])

    asked = spark.createDataFrame([(i, k) for i in taxonomy.ids for k in range(n_per_class)], "true_label string, k int")
    return asked.mapInPandas(write, "doc_id string, text string, true_label string").withColumns({"source": F.lit("mock"), "page_count": F.lit(1)})
