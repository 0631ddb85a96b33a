"""Rules of confused pairs on a corpus whose telling words are known, against plain arithmetic."""

import math
import random
from collections import Counter

from sortarium import taxonomy
from sortarium.operators import distinctions, tiebreak, vectors
from sortarium.taxonomy import Institution, Taxonomy

TELLING = {"courts": ["دعوى", "صك"], "police": ["بلاغ", "دورية"], "tax": ["ضريبة", "فاتورة"]}
SMALL = Taxonomy(tuple(Institution(k, name_ar=f"جهة {k}") for k in TELLING), (("police", "courts"), ("tax", "courts")))


def corpus():
    rng, rows = random.Random(3), []
    shared = ["طلب", "موعد", "مراجعة", "هوية", "the", "form"]
    for label, own in TELLING.items():
        for k in range(30):
            words = [rng.choice(shared) for _ in range(20)] + [rng.choice(own) for _ in range(3)]
            rng.shuffle(words)
            rows.append((label, " ".join(words) + (" نادر" * 9 if k == 0 and label == "tax" else "")))
    return [*rows, (None, "دعوى"), ("tax", None), ("tax", "")]


def test_the_telling_words_are_found_and_rare_or_shared_ones_are_not(spark):
    rows = corpus()
    found = distinctions.distinctions(spark.createDataFrame(rows, "label string, text string"), SMALL.pairs(spark), top=2)
    out = {}
    for r in found.orderBy("a", "b", "label", "place").collect():
        out.setdefault((r.a, r.b, r.label), []).append((r.gram, r.z))
    clean = lambda words: {vectors.T.aggressive_text(w) for w in words}
    assert {k: {g for g, _ in v} for k, v in out.items()} == {(a, b, side): clean(TELLING[side]) for a, b in SMALL.confusion_pairs for side in (a, b)}
    # z by hand
    counts = {label: Counter(w for x, t in rows if x == label and t for w in vectors.word_gram_list(vectors.T.aggressive_text(t), 1)) for label in TELLING}
    total = sum(counts.values(), Counter())
    for (a, b, side), words in out.items():
        for gram, z in words:
            alpha = 500 * total[gram] / total.total()
            odds = [math.log((counts[s][gram] + alpha) / (counts[s].total() + 500 - counts[s][gram] - alpha)) for s in (a, b)]
            want = (odds[0] - odds[1]) / math.sqrt(sum(1 / (counts[s][gram] + alpha) for s in (a, b)))
            assert math.isclose(z, abs(want), rel_tol=1e-9) and (want > 0) == (side == a)


def test_every_declared_pair_gets_rules_that_the_tiebreak_shows(spark, tmp_path):
    gold = spark.createDataFrame(corpus(), "label string, text string")
    made = distinctions.ruled(SMALL, distinctions.distinctions(gold, SMALL.pairs(spark)))
    assert all(i.disambiguation_ar for i in made.institutions)
    rule = made.get("courts").disambiguation_ar
    assert rule.count("إزاء") == 2 and "جهة police" in rule and "جهة tax" in rule
    shown = tiebreak.prompt(made, "police", "courts", "x")
    assert rule in shown and "—" not in shown and rule in made.render_for_prompt("compact")
    taxonomy.save(made, tmp_path / "t.json")
    assert taxonomy.load(str(tmp_path / "t.json")) == made
    by_hand = Taxonomy((Institution("police", disambiguation_ar="mine"), *SMALL.institutions[:1], *SMALL.institutions[2:]), SMALL.confusion_pairs)
    assert distinctions.ruled(by_hand, distinctions.distinctions(gold, SMALL.pairs(spark))).get("police").disambiguation_ar == "mine"
    nothing = distinctions.distinctions(gold.limit(0), SMALL.pairs(spark))
    assert nothing.count() == 0 and distinctions.ruled(SMALL, nothing) == SMALL


def test_shipped_pairs_get_rules_from_generated_documents(spark):
    from sortarium import generate

    full = taxonomy.load()
    docs = generate.templates(spark, full, 12, noise_ratio=0.0, hard_ratio=0.0)
    found = distinctions.distinctions(docs.select(docs.true_label.alias("label"), "text"), full.pairs(spark))
    made = distinctions.ruled(full, found)
    assert all(made.get(side).disambiguation_ar for pair in full.confusion_pairs for side in pair)
