import random

import pytest
from pyspark.sql import functions as F

from sortarium import reporting, taxonomy
from sortarium.operators import evaluate, labels, threshold

TAX = taxonomy.load()
SCORED = "doc_id string, gold string, institution_id string, confidence double, needs_review boolean, backend string, hit int"


def case(spark, high_right, high_wrong, low_right, low_wrong, held=None):
    rows = []
    for n, conf, ok in ((high_right, 0.9, 1), (high_wrong, 0.9, 0), (low_right, 0.3, 1), (low_wrong, 0.3, 0)):
        rows += [(f"d{len(rows) + k}", "moj_courts", "moj_courts" if ok else "gosi", conf, conf < 0.55 if held is None else held, "b", ok) for k in range(n)]
    return spark.createDataFrame(rows, SCORED)


def points(df):
    return {round(r.threshold, 2): r for r in df.collect()}


def test_every_document_is_routed_or_held(spark):
    p = points(threshold.sweep(case(spark, 10, 1, 5, 4)))
    assert len(p) == 21
    assert all(r.auto_routed + r.held == 20 and r.auto_correct + r.misrouted == r.auto_routed for r in p.values())
    covered = [p[t].coverage for t in sorted(p)]
    assert covered == sorted(covered, reverse=True)


def test_sweep_equals_the_definition(spark):
    rng = random.Random(4)
    data = [(f"d{k}", "a", "a" if (ok := rng.random() < 0.6) else "b", rng.choice([rng.random(), *threshold.GRID]), False, "b", int(ok)) for k in range(500)]
    got = threshold.sweep(spark.createDataFrame(data, SCORED)).collect()
    for r in got:
        auto = [d for d in data if d[3] >= r.threshold]
        assert (r.auto_routed, r.auto_correct) == (len(auto), sum(d[6] for d in auto))
        assert r.held_correct == sum(d[6] for d in data) - r.auto_correct


def test_costs(spark):
    (r,) = threshold.sweep(case(spark, 4, 1, 3, 2), grid=(0.5,), misroute=10, review=2).collect()
    assert (r.auto_routed, r.misrouted, r.held, r.expected_cost) == (5, 1, 5, 20)
    (r,) = threshold.sweep(case(spark, 4, 1, 0, 5), grid=(0.5,)).collect()
    assert r.resolved_accuracy == pytest.approx(0.9)


def test_stored_flag_plays_no_part_in_sweeps(spark):
    (r,) = threshold.sweep(case(spark, 2, 0, 2, 0, held=True), grid=(0.0,)).collect()
    assert r.held == 0


def test_an_empty_grid_means_the_default(spark):
    assert threshold.sweep(case(spark, 1, 0, 0, 0), grid=()).count() == 21


def test_recommendations(spark):
    p = threshold.sweep(case(spark, 10, 0, 2, 8))
    best = threshold.recommend_for_target(p, 0.95).first()
    assert best.threshold == pytest.approx(0.35) and best.coverage == 0.5
    assert threshold.recommend_for_target(threshold.sweep(case(spark, 5, 5, 5, 5)), 0.99).first() is None
    assert threshold.recommend_min_cost(p).first().threshold == pytest.approx(0.35)


@pytest.mark.parametrize("args, verdict", [((2, 8, 0, 0), "overconfident"), ((9, 1, 3, 7), "well calibrated"), ((0, 0, 10, 0), "underconfident")])
def test_calibration(spark, args, verdict):
    out = threshold.calibration(case(spark, *args)).first()
    assert out.verdict == verdict
    if args == (2, 8, 0, 0):
        assert out.ece == pytest.approx(0.7)


def test_confidence_one_is_in_the_last_bin(spark):
    rows = spark.createDataFrame([("a", "x", "x", 1.0, False, "b", 1)], SCORED)
    assert threshold.calibration_bins(rows).first().bin == 9


def test_thresholds_by_predicted_class(spark):
    out = {r.institution_id: r for r in threshold.per_class_thresholds(case(spark, 3, 0, 0, 0), TAX.dimension(spark)).collect()}
    assert len(out) == 14 and out["moj_courts"].thin and out["moj_courts"].threshold == 0.0
    assert out["zatca"].threshold is None and (out["zatca"].coverage, out["zatca"].support, out["zatca"].thin) == (0.0, 0, True)


def test_split_is_exact_and_seeded(spark):
    ids = spark.range(1000).select(F.col("id").cast("string").alias("doc_id"))
    a, b = (sorted(r.doc_id for r in threshold.split(ids, seed=7).where("train").collect()) for _ in range(2))
    assert a == b and len(a) == 600
    assert sorted(r.doc_id for r in threshold.split(ids, seed=8).where("train").collect()) != a
    assert threshold.split(ids.limit(0)).count() == 0


def test_split_validation(spark):
    rows = case(spark, 60, 2, 10, 30)
    out = threshold.split_validate(rows, threshold.split(rows.select("doc_id"))).first()
    assert out.optimism == pytest.approx(out.train_accuracy - out.test_accuracy) and out.n_test == 41
    assert threshold.split_validate(rows, threshold.split(rows.select("doc_id")), target=1.1).first() is None


def test_evaluate_two_documents(spark):
    rows = spark.createDataFrame([("a", "gosi", "gosi", 0.9, False, "x", 1), ("b", "gosi", "zatca", 0.2, True, "x", 0)], SCORED)
    r = evaluate.summary(rows).first()
    assert (r.accuracy, r.auto_routed, r.auto_accuracy, r.held, r.held_correct) == (0.5, 1, 1.0, 1, 0)
    assert r.mean_confidence_correct == 0.9 and r.mean_confidence_wrong == 0.2
    c = {x.institution_id: x for x in evaluate.per_class(rows, TAX.dimension(spark)).collect()}
    assert (c["gosi"].tp, c["gosi"].fn, c["gosi"].recall, c["zatca"].fp, c["zatca"].support) == (1, 1, 0.5, 1, 0)
    assert "50.0%" in reporting.summary(r.asDict() | {"macro_f1": 0.5}, [("a <-> b", 0), ("c <-> d", 2)])


def test_unmatched_predictions_raise(spark):
    rows = case(spark, 1, 0, 0, 0)
    truth = spark.createDataFrame([("zzz", "gosi")], "doc_id string, gold string")
    with pytest.raises(ValueError):
        evaluate.require_rows(evaluate.scored(truth, rows.drop("gold", "hit")))


def test_truth_skips_unlabelled_and_takes_the_last(spark):
    docs = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "", 3), ("c", None, 4)], "doc_id string, true_label string, n int")
    assert [tuple(r) for r in evaluate.truth_of(docs, order="n").collect()] == [("a", "y")]


def test_confusion_holds_zeros_of_declared_pairs(spark):
    cells = {(r.gold, r.predicted): r.n for r in evaluate.confusion(case(spark, 2, 1, 0, 0), TAX.pairs(spark)).collect()}
    assert cells[("moj_courts", "gosi")] == 1 and cells[("hrsd_labor", "gosi")] == 0 == cells[("gosi", "hrsd_labor")]
    assert len(cells) == 2 + 16
    errors = {r.pair: r.errors for r in evaluate.pair_errors(evaluate.confusion(case(spark, 2, 1, 0, 0), TAX.pairs(spark)), TAX.pairs(spark)).collect()}
    assert len(errors) == 8 and set(errors.values()) == {0}


LOG = "doc_id string, label string, status string, lane string, model_label string, seconds_spent double, reviewer string, seq long"


def log(spark, *rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], LOG)


def test_last_decision_counts(spark):
    df = log(spark, ("d1", "gosi", "labeled", "random", "gosi", 3.0, "r"), ("d1", "zatca", "labeled", "random", "gosi", 5.0, "r"))
    now = labels.current(df)
    assert [r.label for r in now.collect()] == ["zatca"] and labels.stats(df).first().total_records == 2


def test_lanes_and_gold(spark):
    now = labels.current(log(spark, ("a", "gosi", "labeled", "random", "gosi", 1.0, "r"), ("b", "gosi", "labeled", "random", "zatca", 2.0, "r"), ("c", "zatca", "labeled", "priority", "zatca", 3.0, "r"), ("s", "", "skipped", "random", "gosi", 0.0, "r")))
    lanes = {r.lane: r for r in labels.lanes(now).collect()}
    assert (lanes["random"].n, lanes["random"].agreed, lanes["priority"].n, lanes["priority"].agreed) == (2, 1, 1, 1)
    assert {r.label: r.n for r in labels.per_class(now).collect()} == {"gosi": 2, "zatca": 1}
    assert labels.gold(now).count() == 3 and labels.decided(now).count() == 4
    assert labels.upper_median(now, "seconds_spent").first()[0] == 2.0
    cover = {r.institution_id: r.need for r in labels.coverage(now, TAX.dimension(spark)).collect()}
    assert cover["gosi"] == 23 and cover["zatca"] == 24 and cover["moh_health"] == 25


@pytest.mark.parametrize("values, median", [([1, 2, 3, 4], 3), ([5], 5), ([1, 1, 1, 9], 1), ([0, 2, None, 4], 4)])
def test_upper_median(spark, values, median):
    rows = spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "v double")
    assert labels.upper_median(rows, "v").first()[0] == median


def test_wilson(spark):
    low, high = labels.wilson(F.col("a"), F.col("n"))
    rows = spark.createDataFrame([(4, 4), (60, 60), (0, 0)], "a int, n int").select("n", low.alias("low"), high.alias("high")).collect()
    four, sixty, none = rows
    assert four.low < sixty.low < 1 and four.low == pytest.approx(0.5101, abs=1e-3) and (none.low, none.high) == (0, 0)


def test_bad_records_fail(spark):
    df = spark.createDataFrame([("d", "nowhere", "labeled", "x" * 3000)], "doc_id string, label string, status string, notes string")
    with pytest.raises(Exception, match="label outside the taxonomy"):
        labels.checked(df, TAX.ids).collect()
    assert len(labels.checked(df.withColumn("label", F.lit(" gosi ")), TAX.ids).first().notes) == 2000


def test_taxonomy_rejects_typos(spark):
    i = taxonomy.Institution
    for bad in (dict(institutions=(i("a"), i("a"))), dict(institutions=(i("manual_review"),)), dict(institutions=(i("a"),), confusion_pairs=(("a", "b"),))):
        with pytest.raises(ValueError):
            taxonomy.Taxonomy(**bad)
    assert len(TAX.ids) == 14 and len(TAX.confusion_pairs) == 8
    assert TAX.render_for_prompt() == TAX.render_for_prompt() and len(TAX.render_for_prompt("compact")) < len(TAX.render_for_prompt())
    named = taxonomy.with_names(spark.createDataFrame([("gosi",), ("manual_review",), ("zz",)], "i string"), TAX.dimension(spark), "i", "n")
    assert {r.i: r.n for r in named.collect()}["manual_review"] == "مراجعة يدوية" and {r.i: r.n for r in named.collect()}["zz"] == "zz"


def test_reports_are_ordered(spark):
    rows = case(spark, 10, 1, 5, 4)
    assert [r.threshold for r in reporting.sweep(threshold.sweep(rows), 0.9).collect()] == sorted(threshold.GRID)
    assert "target" in reporting.formatted(reporting.sweep(threshold.sweep(rows), 0.9))
    assert [r.institution_id for r in reporting.class_thresholds(threshold.per_class_thresholds(rows, TAX.dimension(spark))).collect()] == TAX.ids


def test_tables_and_viewer_say_what_they_leave_out(spark):
    rows = spark.range(7).select(F.col("id").cast("string").alias("doc_id"), F.lit("text").alias("text"), F.lit("a").alias("label"), F.lit("hard").alias("difficulty"))
    assert reporting.formatted(rows, 5).splitlines()[-1] == "(only the first 5 rows are shown)" and len(reporting.formatted(rows, 7).splitlines()) == 8
    first, second = reporting.corpus_viewer(rows, 5), reporting.corpus_viewer(rows, 5, after="4")
    assert "&quot;shown&quot;: 5" in first and "&quot;shown&quot;: 2" in second and '"doc_id": "6"' in second and '"doc_id": "6"' not in first
