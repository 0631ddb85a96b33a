"""The command line: taxonomy, generate, classify, train-baseline, evaluate, threshold, batch, label, prompt, local."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortarium import generate, reporting, review, session, taxonomy
from sortarium.operators import baseline, classify, distinctions, evaluate, fewshot, gateway, labels, queue, threshold, tiebreak
from sortarium.sources import documents as io

THIN, SMALL_RANDOM, BAD_ECE, BAD_OPTIMISM = 15, 30, 0.15, 0.05


def _say(text: str) -> None:
    print(text)


def _warn(text: str) -> None:
    print(f"warning: {text}", file=sys.stderr)


def _classifier(a, tax, spark):
    if a.backend == "llm" or getattr(a, "ocr", None) == "gateway":
        _warn("document contents leave this machine")
    examples = fewshot.load(a.examples) if getattr(a, "examples", None) else {"examples": []}
    shown = fewshot.render(examples["examples"], tax)
    made = classify.create_classifier(a.backend, taxonomy=tax, spark=spark, threshold=a.threshold, model=a.model, base_url=a.gateway, examples=shown, n_examples=len(examples["examples"]), redact=not a.raw)
    if getattr(a, "tiebreak", False):
        made = tiebreak.TiebreakClassifier(made, gateway.resolver(gateway.HttpClient(a.gateway), a.model, tax), tax)
    return made, {e["doc_id"] for e in examples["examples"]}


def _limited(docs, n: int):
    return docs.orderBy("doc_id").limit(n) if n else docs


def cmd_taxonomy(a, spark, tax):
    if a.gold:
        gold = io.read_documents(spark, a.gold).select(F.col("true_label").alias("label"), "text")
        tax = distinctions.ruled(tax, distinctions.distinctions(gold, tax.pairs(spark)))
        for i in tax.institutions:
            if i.disambiguation_ar:
                _say(f"{i.id}: {i.disambiguation_ar}")
    if a.out:
        taxonomy.save(tax, a.out)
    _say(reporting.formatted(reporting.institutions(tax, spark)))


def cmd_generate(a, spark, tax):
    if a.mode == "curated":
        docs = generate.curated(spark, tax, a.corpus, a.hard_only, a.noise_ratio, a.seed)
    elif a.mode == "model":
        docs = generate.by_model(spark, tax, gateway.HttpClient(a.gateway), a.model, a.per_class)
    else:
        docs = generate.templates(spark, tax, a.per_class, a.seed, a.hard_ratio, a.noise_ratio)
    (io.save_as_files if a.files else io.write_jsonl)(docs, a.out)


def cmd_classify(a, spark, tax):
    docs = _limited(io.read_documents(spark, a.path, a.ocr), a.limit)
    made, shown = _classifier(a, tax, spark)
    if leaked := [r[0] for r in docs.where(F.col("doc_id").isin(*shown)).select("doc_id").collect()] if shown else []:
        _warn(f"documents are examples of the prompt too: {leaked}")
    predictions = classify.gated(made.predict(docs), a.threshold)
    io.write_jsonl(predictions, a.out)
    predictions = io.read_predictions(spark, a.out)
    _say(reporting.formatted(reporting.routing(predictions, tax)))
    _say(f"held for review: {predictions.where('needs_review').count()}")


def cmd_train(a, spark, tax):
    docs = io.read_documents(spark, a.path)
    thin = [r[0] for r in docs.groupBy("true_label").count().where(F.col("count") < THIN).collect()]
    if thin:
        _warn(f"fewer than {THIN} documents for {thin}")
    parts = threshold.split(docs.select("doc_id"), 0.25)
    both = docs.join(parts, "doc_id")
    model = baseline.Baseline().fit(both.where("train").drop("train"))
    model.save(a.out, spark)
    rows = evaluate.scored(evaluate.truth_of(docs), model.predict(both.where("NOT train")))
    _say(reporting.formatted(evaluate.summary(rows)))


def _rows(a, spark):
    docs, predictions = io.read_documents(spark, a.docs), io.read_predictions(spark, a.predictions)
    truth = evaluate.truth_of(docs)
    n = evaluate.mismatch(truth, predictions).first()
    if n.scored < max(n.labelled, n.predicted):
        _warn(f"{n.labelled} labelled, {n.predicted} predicted, {n.scored} scored")
    return evaluate.require_rows(evaluate.scored(truth, predictions)).persist()


def cmd_evaluate(a, spark, tax):
    rows = _rows(a, spark)
    classes, pairs = evaluate.per_class(rows, tax.dimension(spark)), tax.pairs(spark)
    report = evaluate.summary(rows).crossJoin(evaluate.macro_f1(classes)).first().asDict()
    cells = evaluate.confusion(rows, pairs)
    errors = [tuple(r) for r in evaluate.pair_errors(cells, pairs).collect()]
    _say(reporting.summary(report, errors))
    _say(reporting.formatted(reporting.per_class(classes)))
    _say(reporting.formatted(evaluate.misroutes(rows)))
    if a.out:
        Path(a.out).write_text(json.dumps(report | {"confusion_pair_errors": dict(errors)}, ensure_ascii=False, indent=2), encoding="utf-8")


def cmd_threshold(a, spark, tax):
    rows = _rows(a, spark)
    cal = threshold.calibration(rows).first()
    if cal.ece >= BAD_ECE:
        _warn(f"confidence is poorly calibrated: {cal.ece:.3f}, {cal.verdict}")
    points = threshold.sweep(rows, misroute=a.misroute, review=a.review).persist()
    _say(reporting.formatted(reporting.reliability(threshold.calibration_bins(rows))))
    _say(reporting.formatted(reporting.sweep(points, a.target)))
    checked = threshold.split_validate(rows, threshold.split(rows.select("doc_id").distinct()), a.target, a.misroute, a.review, a.mode).first()
    if checked and checked.optimism > BAD_OPTIMISM:
        _warn(f"held-out accuracy is {checked.optimism:.1%} lower")
    out = {"calibration": cal.asDict(), "sweep": [r.asDict() for r in points.orderBy("threshold").collect()], "validation": checked and checked.asDict(), "costs": {"misroute": a.misroute, "review": a.review}}
    best = threshold.recommend_for_target(points, a.target).first()
    out |= {"recommended_target": best and best.threshold, "recommended_cost": threshold.recommend_min_cost(points).first().threshold}
    if a.per_class:
        per = threshold.per_class_thresholds(rows, tax.dimension(spark), a.target)
        _say(reporting.formatted(reporting.class_thresholds(per)))
        out["per_class"] = [r.asDict() for r in per.collect()]
    if a.out:
        Path(a.out).write_text(json.dumps(out, ensure_ascii=False, indent=2), encoding="utf-8")


def cmd_batch(a, spark, tax):
    made, _ = _classifier(a, tax, spark)
    batches = gateway.Batches(made, gateway.HttpBatches(gateway.HttpClient(a.gateway), a.model))
    if a.what == "submit":
        ids = batches.submit(_limited(io.read_documents(spark, a.path), a.limit), f"{a.out}.ledger")
        Path(a.out).write_text(json.dumps(ids), encoding="utf-8")
        return _say("\n".join(ids))
    ids = json.loads(Path(a.path).read_text(encoding="utf-8"))
    if waiting := [i for i in ids if batches.port.status(i) != "ended"]:
        raise ValueError(f"not ended yet: {', '.join(waiting)}")
    good, bad = batches.collect(ids, spark)
    io.write_jsonl(good, a.out)
    if failed := bad.limit(1000).collect():
        _warn("without a prediction: " + "; ".join(f"{r.doc_id} ({r.error})" for r in failed))


def cmd_difficulty(a, spark, tax):
    train = generate.templates(spark, tax, a.per_class, a.seed)
    sets = {"templates": generate.templates(spark, tax, a.per_class, a.seed + 1)}
    if a.corpus:
        sets |= {"curated": generate.curated(spark, tax, a.corpus), "curated, hard": generate.curated(spark, tax, a.corpus, hard_only=True)}
    _say(reporting.formatted(evaluate.difficulty(baseline.Baseline(), train, sets, tax.dimension(spark))))


def cmd_label(a, spark, tax):
    log = review.LocalLog(a.log)
    now = labels.current(log.table(spark))
    if a.what == "prelabel":
        docs = io.read_documents(spark, a.path)
        free = queue.pool(docs, labels.decided(now))
        if a.backend == "none":
            from sortarium import schemas

            predictions = spark.createDataFrame([], schemas.PREDICTION)
        else:
            predictions = _classifier(a, tax, spark)[0].predict(free).persist()
        io.write_jsonl(queue.build_queue(free, predictions, None, labels.decided(now), tax.pairs(spark), a.size, a.random_ratio, a.cap), a.out)
    elif a.what == "review":
        served = review.server(review.ReviewSession(io.read_queue(spark, a.path), log, a.reviewer, tax), port=a.port)
        _say(f"http://127.0.0.1:{a.port}/")
        served.serve_forever()
    elif a.what == "status":
        lanes = labels.lanes(now)
        for df in (labels.stats(log.table(spark)), lanes, labels.reviewers(now), reporting.coverage(labels.coverage(now, tax.dimension(spark)))):
            _say(reporting.formatted(df))
        if lanes.where(f"lane = 'random' AND n < {SMALL_RANDOM}").count():
            _warn(f"fewer than {SMALL_RANDOM} labels in the random lane")
    else:
        docs = io.read_documents(spark, a.path)
        io.write_jsonl(labels.exported(docs, now), a.out)
        if n := labels.missing(docs, now).count():
            _warn(f"{n} confirmed labels have no document")


def cmd_prompt(a, spark, tax):
    if a.what == "show":
        return _say(fewshot.render(fewshot.load(a.out)["examples"], tax))
    now = labels.current(review.LocalLog(a.log).table(spark))
    rows = fewshot.select_examples(io.read_documents(spark, a.path), labels.gold(now), now.select("doc_id", "model_label"), tax.dimension(spark), a.per_class, a.max_examples)
    fewshot.save(rows, a.out, tax.version)
    _say(reporting.formatted(fewshot.counts(rows)))


def cmd_local(a, spark, tax):
    _say(json.dumps(gateway.preflight(gateway.HttpClient(a.gateway), a.model), ensure_ascii=False))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sortarium", description=__doc__)
    p.add_argument("--taxonomy")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, *arguments: tuple, model: bool = False):
        s = sub.add_parser(name)
        for names, options in arguments:
            s.add_argument(*names.split(), **options)
        if model:
            for names, options in (("--backend", {"default": "local"}), ("--model", {"default": ""}), ("--gateway", {"default": "http://127.0.0.1:8000/v1"}), ("--threshold", {"type": float, "default": classify.REVIEW_THRESHOLD}), ("--raw", {"action": "store_true"}), ("--examples", {}), ("--tiebreak", {"action": "store_true"}), ("--ocr", {})):
                s.add_argument(names, **options)
        s.set_defaults(run=run)

    n = lambda default: {"type": int, "default": default}
    x = lambda default: {"type": float, "default": default}
    add("taxonomy", cmd_taxonomy, ("--gold", {}), ("--out", {}))
    add("generate", cmd_generate, ("out", {}), ("--mode", {"choices": ("templates", "curated", "model"), "default": "templates"}), ("--per-class", n(20)), ("--seed", n(7)), ("--hard-ratio", x(generate.HARD_RATIO)), ("--noise-ratio", x(generate.NOISE_RATIO)), ("--corpus", {}), ("--hard-only", {"action": "store_true"}), ("--gateway", {"default": "http://127.0.0.1:8000/v1"}), ("--model", {"default": ""}), ("--files", {"action": "store_true"}))
    add("difficulty", cmd_difficulty, ("--corpus", {}), ("--per-class", n(20)), ("--seed", n(7)))
    add("classify", cmd_classify, ("path", {}), ("out", {}), ("--limit", n(0)), model=True)
    add("train-baseline", cmd_train, ("path", {}), ("out", {}))
    add("evaluate", cmd_evaluate, ("docs", {}), ("predictions", {}), ("--out", {}))
    add("threshold", cmd_threshold, ("docs", {}), ("predictions", {}), ("--target", x(0.95)), ("--misroute", x(20.0)), ("--review", x(1.0)), ("--mode", {"choices": ("target", "cost"), "default": "target"}), ("--per-class", {"action": "store_true"}), ("--out", {}))
    add("batch", cmd_batch, ("what", {"choices": ("submit", "collect")}), ("path", {}), ("out", {}), ("--limit", n(0)), model=True)
    add("label", cmd_label, ("what", {"choices": ("prelabel", "review", "status", "export")}), ("log", {}), ("--path", {}), ("--out", {}), ("--size", n(50)), ("--random-ratio", x(0.2)), ("--cap", {"type": int}), ("--reviewer", {"default": "reviewer"}), ("--port", n(8765)), model=True)
    add("prompt", cmd_prompt, ("what", {"choices": ("build", "show")}), ("out", {}), ("--log", {}), ("--path", {}), ("--per-class", n(1)), ("--max-examples", n(20)))
    add("local", cmd_local, ("what", {"choices": ("check",)}), ("--gateway", {"default": "http://127.0.0.1:8000/v1"}), ("--model", {"default": ""}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session.get()
    try:
        a.run(a, spark, taxonomy.load(a.taxonomy))
    except (FileNotFoundError, ValueError, io.OCRUnavailable, gateway.GatewayError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
