import io as _io
import json
import threading
import urllib.error
import urllib.request
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sortarium import generate, review, schemas, taxonomy
from sortarium.operators import classify, fewshot, gateway, labels, queue, tiebreak
from sortarium.sources import documents as io
from sortarium.streaming import route

TAX = taxonomy.load()
PRED = "doc_id string, institution_id string, confidence double, alternatives array<struct<institution_id: string, confidence: double>>, baseline_label string"


def docs(spark, n=40, text=None):
    return spark.createDataFrame([(f"d{k:02d}", text(k) if text else f"وثيقة رقم {k} عن موضوع {'abcdefgh'[k % 8] * 4}", "plain", None, 1, None) for k in range(n)], schemas.DOCUMENT)


def predictions(spark, n=40, labels_=("gosi", "zatca")):
    rows = [(f"d{k:02d}", labels_[k % len(labels_)], (k % 10) / 10, "", [("hrsd_labor", 0.1)], k % 10 < 5, "stub") for k in range(n)]
    return spark.createDataFrame(rows, schemas.PREDICTION)


# --- queue


def test_priority_score(spark):
    rows = spark.createDataFrame([("a", "gosi", 0.5, [("hrsd_labor", 0.4)], "zatca"), ("b", None, None, None, None), ("c", "gosi", 1.0, [], "gosi")], PRED)
    out = {r.doc_id: r for r in queue.priority(rows, TAX.pairs(spark)).collect()}
    assert out["a"].score == pytest.approx(0.5 + 0.8 * 0.9 + 0.6 + 1.2)
    assert out["a"].reasons == ["ثقة منخفضة (0.50)", "فارق ضئيل عن البديل (0.10)", "زوج خلط معروف", "اختلاف بين النموذجين"]
    assert (out["b"].score, out["b"].reasons) == (1.0, ["بلا تنبؤ"]) and (out["c"].score, out["c"].reasons) == (0.0, [])


def test_queue_has_both_lanes(spark):
    none = spark.createDataFrame([], "doc_id string")
    items = queue.build_queue(docs(spark), predictions(spark), None, none, TAX.pairs(spark), size=20, random_ratio=0.25).collect()
    assert len(items) == 20 == len({r.doc_id for r in items}) and sum(r.lane == "random" for r in items) == 5
    assert sorted(r.position for r in items) == list(range(1, 21))
    again = queue.build_queue(docs(spark), predictions(spark), None, none, TAX.pairs(spark), size=20, random_ratio=0.25).collect()
    assert {r.doc_id for r in again} == {r.doc_id for r in items}


def test_decided_documents_are_not_queued(spark):
    done = spark.createDataFrame([(f"d{k:02d}",) for k in range(30)], "doc_id string")
    items = queue.build_queue(docs(spark), predictions(spark), None, done, TAX.pairs(spark), size=20).collect()
    assert len(items) == 10 and all(r.doc_id >= "d30" for r in items)


def test_class_cap(spark):
    none = spark.createDataFrame([], "doc_id string")
    items = queue.build_queue(docs(spark), predictions(spark, labels_=("gosi",)), None, none, TAX.pairs(spark), size=20, random_ratio=0.0, cap=4)
    assert items.count() <= 4


def test_lane_size_rounds_half_to_even():
    assert [queue.lane_size(s, 0.25, 100) for s in (2, 6, 10, 50)] == [0, 2, 2, 12] and queue.lane_size(50, 0.2, 3) == 3


def test_pruned_greedy_equals_the_whole(spark):
    rng = np.random.default_rng(2)
    for cap in (None, 3):
        pdf = pd.DataFrame({"doc_id": range(120), "score": rng.random(120) * 6, "label": rng.choice(list("abc"), 120), "v": [x.tolist() for x in rng.normal(size=(120, 6))]})
        rows = spark.createDataFrame(pdf)
        got = {r.doc_id: r.pick for r in queue.diverse(rows, 10, cap, vector="v").collect()}
        s = pdf.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        m = np.array(s.v.tolist())
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        chosen, used, left = [], {}, list(range(120))
        while left and len(chosen) < 10:
            best = max(left, key=lambda i: (s.score[i] - (1.5 * max(m[i] @ m[j] for j in chosen) if chosen else 0), -i))
            left.remove(best)
            if cap and used.get(s.label[best], 0) >= cap:
                continue
            used[s.label[best]] = used.get(s.label[best], 0) + 1
            chosen.append(best)
        assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [int(s.doc_id[i]) for i in chosen]


def test_blind_items_hide_the_model(spark):
    none = spark.createDataFrame([], "doc_id string")
    items = queue.build_queue(docs(spark), predictions(spark), None, none, TAX.pairs(spark), size=10, random_ratio=0.5)
    for r in queue.blind(items).collect():
        if r.lane == "random":
            assert r.model_label is None and r.alternatives == [] and r.reasons == [queue.RANDOM_REASON] and r.score == 0
        else:
            assert r.model_label is not None


# --- examples


def gold(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id string, label string"), spark.createDataFrame([], "doc_id string, model_label string")


def test_corrections_come_first(spark):
    g, _ = gold(spark, [(f"d{k:02d}", "gosi") for k in range(10)])
    said = spark.createDataFrame([(f"d{k:02d}", "zatca" if k >= 7 else "gosi") for k in range(10)], "doc_id string, model_label string")
    out = fewshot.select_examples(docs(spark), g, said, TAX.dimension(spark), per_class=0, max_examples=3).collect()
    assert [r.doc_id for r in out] == ["d07", "d08", "d09"] and {r.corrected_from for r in out} == {"zatca"}
    block = fewshot.render([r.asDict() for r in out], TAX)
    assert block.count("تنبيه") == 3 and block == fewshot.render([r.asDict() for r in out], TAX) and fewshot.render([], TAX) == ""


def test_every_class_is_covered_and_unknowns_dropped(spark):
    g, none = gold(spark, [("d00", "gosi"), ("d01", "gosi"), ("d02", "zatca"), ("d03", "nowhere"), ("ghost", "gosi"), ("d04", "moh_health")])
    out = fewshot.select_examples(docs(spark, text=lambda k: " \n" if k == 4 else "نص " * 100), g, none, TAX.dimension(spark), per_class=1, max_examples=3, max_chars=200).collect()
    assert [(r.label, r.doc_id) for r in out] == [("gosi", "d00"), ("gosi", "d01"), ("zatca", "d02")]
    assert all(r.truncated and r.text.endswith("…") for r in out)
    assert [r[0] for r in fewshot.leakage(spark.createDataFrame([(r.doc_id,) for r in out], "doc_id string"), docs(spark, 1)).collect()] == ["d00"]


# --- classifiers


class Stub:
    name = "stub"

    def __init__(self, rows):
        self.rows = rows

    def predict(self, _):
        return self.rows


def pair_rows(spark, confidence=0.6):
    return spark.createDataFrame([("d00", "gosi", confidence, "why", [("zatca", 0.2), ("hrsd_labor", 0.1)], False, "stub"), ("d01", "gosi", 0.6, "why", [("zatca", 0.2)], False, "stub")], schemas.PREDICTION)


def test_partner_ranked_second_is_found(spark):
    assert [r.partner for r in tiebreak.gated(pair_rows(spark), TAX).orderBy("doc_id").collect()] == ["hrsd_labor", None]


@pytest.mark.parametrize("confidence, asked", [(0.9, True), (0.91, False)])
def test_tiebreak_gate(spark, confidence, asked):
    t = tiebreak.TiebreakClassifier(Stub(None), lambda text, a, b: (b, 1.7, ""), TAX)
    out = {r.doc_id: r for r in t.resolve(pair_rows(spark, confidence), docs(spark, 2)).collect()}
    assert out["d00"].institution_id == ("hrsd_labor" if asked else "gosi") and out["d00"].adjudicated is asked
    assert out["d00"].rationale_ar == "why" and out["d00"].needs_review is False and (not asked or out["d00"].confidence == 1.0)


def test_failing_resolver_keeps_the_first(spark):
    def fails(text, a, b):
        raise RuntimeError

    for resolver in (fails, lambda text, a, b: ("moh_health", 0.9, "")):
        t = tiebreak.TiebreakClassifier(Stub(None), resolver, TAX)
        out = t.resolve(pair_rows(spark), docs(spark, 2))
        assert {r.institution_id for r in out.collect()} == {"gosi"}
        assert tuple(tiebreak.counters(out).first()) == (0, 0)


class Gateway:
    """Replies in turn; refuses the ways of asking that it doesn't know."""

    def __init__(self, reply, takes=("json_schema", "json_object", None)):
        self.reply, self.takes = reply, takes

    def chat(self, response_format=None, **_):
        if (response_format or {}).get("type") not in self.takes:
            raise gateway.GatewayError("400")
        return self.reply

    def models(self):
        return ["m"]


GOOD = json.dumps({"institution_id": "gosi", "confidence": 0.4, "rationale_ar": "ل", "alternatives": [{"institution_id": "x", "confidence": 1}, {"institution_id": "zatca", "confidence": 0.2}]})


def test_gateway_classifies(spark):
    c = classify.create_classifier("local", taxonomy=TAX, client=Gateway(GOOD), model="m")
    (r,) = c.predict(docs(spark, 1)).collect()
    assert (r.institution_id, r.needs_review, [a.institution_id for a in r.alternatives], r.backend) == ("gosi", True, ["zatca"], "local:m")


def test_negotiation(spark):
    assert [gateway.negotiate(Gateway("", takes), "m", TAX) for takes in (("json_schema",), ("json_object",), (None,))] == ["json_schema", "json_object", "prompt"]
    with pytest.raises(gateway.GatewayError):
        gateway.negotiate(Gateway("", ()), "m", TAX)

    class Down(Gateway):
        def chat(self, **_):
            raise gateway.GatewayUnavailable("down")

    with pytest.raises(gateway.GatewayUnavailable):
        gateway.negotiate(Down(""), "m", TAX)


def test_bad_replies(spark):
    ask = lambda reply: gateway.GatewayClassifier(TAX, Gateway(reply), "m", strategy="prompt")
    assert ask("no").attempt(docs(spark, 1)).first().error.startswith("unparseable")
    assert ask('{"institution_id": "made_up"}').attempt(docs(spark, 1)).first().error.startswith("invalid")
    with pytest.raises(Exception, match="made_up"):
        ask('{"institution_id": "made_up"}').predict(docs(spark, 1)).collect()
    assert gateway.preflight(Gateway(""), "m")["model_present"] and ask("").name == "local:m+prompt"


def test_request_holds_no_identifier(spark):
    seen = gateway.T.envelope(F.col("text"), F.col("source"), F.col("page_count"))
    (r,) = docs(spark, 1, lambda k: "هوية 1042779318").select(seen.alias("t")).collect()
    assert "1042779318" not in r.t and "[رقم هوية]" in r.t


class FolderPort:
    """A service that keeps its batches in a folder and takes a name once; the first submission of each batch fails after it was taken."""

    def __init__(self, folder, failing=False):
        self.folder, self.failing = folder, failing

    def submit(self, requests, once):
        from pathlib import Path

        file = Path(self.folder, once)
        new = not file.exists()
        file.write_text(json.dumps([requests, 1 if new else json.loads(file.read_text())[1] + 1]))
        if new and self.failing:
            raise gateway.GatewayUnavailable("the answer got lost")
        return once

    def results(self, batch_id):
        from pathlib import Path

        for i, _, content in json.loads(Path(self.folder, batch_id).read_text())[0]:
            yield i, {"d00": None, "d02": "?", "d03": gateway.GatewayError("overloaded"), "d04": GOOD.replace("gosi", "nobody")}.get(i, GOOD)


def test_batches_match_ids_and_no_document_is_submitted_twice(spark, tmp_path):
    (tmp_path / "service").mkdir()
    port = FolderPort(str(tmp_path / "service"), failing=True)
    b = gateway.Batches(gateway.GatewayClassifier(TAX, None, "m", strategy="prompt"), port)
    ledger = str(tmp_path / "ledger")
    for _ in range(20):  # answers get lost until every batch has been taken once
        try:
            ids = b.submit(docs(spark, 23), ledger, chunk=5)
            break
        except Exception as e:
            assert "got lost" in str(e)
    taken = {f.name: json.loads(f.read_text()) for f in (tmp_path / "service").iterdir()}
    assert sorted(taken) == ids and all(len(requests) <= 5 for requests, _ in taken.values())
    assert sorted(r[0] for requests, _ in taken.values() for r in requests) == [f"d{k:02}" for k in range(23)]
    assert b.submit(docs(spark, 23), ledger, chunk=5) == [] and len(b.submit(docs(spark, 25), ledger, chunk=5) if not port.failing else [1]) == 1
    good, bad = b.collect(ids, spark)
    failed = {r.doc_id: r.error.split(":")[0] for r in bad.collect()}
    assert failed == {"d00": "refusal", "d02": "unparseable", "d03": "overloaded"} | ({"d04": "invalid"} if "gosi" in GOOD else {})
    assert {r.doc_id for r in good.collect()} == {f"d{k:02}" for k in range(23)} - set(failed)
    assert [x.count() for x in b.collect([], spark)] == [0, 0]


def test_unknown_backend():
    with pytest.raises(classify.UnknownBackend):
        classify.create_classifier("nobody")
    with pytest.raises(classify.MissingModel):
        classify.create_classifier("baseline", taxonomy=TAX)
    assert {"local", "llm", "baseline"} <= set(classify.available_backends())


def test_ties_go_to_the_smaller_id(spark):
    shares = F.array(*[F.struct(F.lit(0.25).alias("confidence"), F.lit(i).alias("institution_id")) for i in "cabd"])
    (r,) = spark.range(1).select(*[c.alias(n) for n, c in classify.ranked(shares).items()]).collect()
    assert r.institution_id == "a" and [a.institution_id for a in r.alternatives] == ["b", "c"]


def test_baseline_learns_and_survives_saving(spark, tmp_path):
    from sortarium.operators.baseline import Baseline

    small = taxonomy.Taxonomy(TAX.institutions[:3], TAX.confusion_pairs[:2])
    made = generate.templates(spark, small, 16, noise_ratio=0.0, hard_ratio=0.0)
    train, test = made.where("pmod(xxhash64(doc_id), 4) > 0"), made.where("pmod(xxhash64(doc_id), 4) = 0")
    model = Baseline(char_features=2000, word_features=1000, folds=2).fit(train)
    out = model.predict(test)
    hits = out.join(test.select("doc_id", "true_label"), "doc_id").select((F.col("institution_id") == F.col("true_label")).cast("int").alias("h")).agg(F.avg("h")).first()[0]
    assert hits >= 0.85
    again = Baseline.load(model.save(str(tmp_path / "m"), spark), spark).predict(test)
    assert sorted((r.doc_id, r.institution_id, round(r.confidence, 9)) for r in out.collect()) == sorted((r.doc_id, r.institution_id, round(r.confidence, 9)) for r in again.collect())
    with pytest.raises(ValueError):
        Baseline().fit(train.withColumn("true_label", F.lit("")))


def test_tfidf_query_covers_every_document(spark, tmp_path):
    from sortarium.plans import registry

    # One language has even ids only, one odd ids only; a document has no language and one no id.
    words = {"en": "the river and the stone", "de": "der Fluss und der Stein"}
    rows = [(2 * k + (lang == "de"), f"{words[lang]} {k % 3}", lang) for lang in words for k in range(12)] + [(100, words["en"], None), (None, words["de"], "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = registry.QUERIES["tfidf_baseline"](spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows)
    want = {i: lang or "en" for i, _, lang in rows}
    assert all(r.institution_id == want[r.doc_id] for r in out)


# --- sources and sinks


def docx_bytes():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = f'<w:document xmlns:w="{w}"><w:body>{p("one")}{p("two")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl></w:body></w:document>'
    out = _io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    return out.getvalue()


def test_folder_scan(spark, tmp_path):
    (tmp_path / "nested").mkdir()
    for name, text in (("b.txt", "B"), ("a.txt", "A‏"), ("nested/c.md", "C"), ("ignore.zip", "Z")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "d.docx").write_bytes(docx_bytes())
    out = io.read_documents(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.text) for r in out] == [("a", "A"), ("b", "B"), ("d", "one\ntwo\na b"), ("c", "C")]
    with pytest.raises(FileNotFoundError):
        io.read_documents(spark, str(tmp_path / "none.txt"))
    with pytest.raises(io.UnsupportedDocument):
        io.read_documents(spark, str(tmp_path / "ignore.zip"))


def test_text_files_are_one_plain_file_a_document_and_none_is_lost(spark, tmp_path, monkeypatch):
    rows = [("a/1", " one ", "en"), ("a_1", "two", "en"), ("a_1", "three", "en"), ("_b", "four", None), (".", None, "x/y"), ("c", "five", "en")]
    df = spark.createDataFrame(rows, "doc_id string, text string, true_label string").coalesce(1)
    for _ in range(2):
        io.write_text_files(df, str(tmp_path / "out"))
    files = [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert len(files) == 6 and all(p.name.endswith(".txt") for p in files)
    assert (tmp_path / "out" / "label=en").is_dir() and [p.read_text() for p in files if p.name == "c.txt"] == ["five"]
    got = {}
    for places in (4000, 2):  # folders dealt out by the driver, and left to tasks
        monkeypatch.setattr(io, "_PLACES", places)
        back = io.read_files(spark, str(tmp_path / "out")).collect()
        assert [r.path for r in back] == sorted(r.path for r in back)
        got[places] = sorted((r.doc_id.split("~")[0], r.text, r.path.split("label=")[1].split("/")[0]) for r in back)
    assert got[4000] == got[2] == sorted([("a_1", "one", "en"), ("a_1", "two", "en"), ("a_1", "three", "en"), ("_b", "four", "unlabeled"), (".", "", "x%2Fy"), ("c", "five", "en")])


def test_unknown_ocr_backends_are_refused():
    with pytest.raises(io.OCRUnavailable):
        io.ocr_backend("nobody")


def test_jsonl_round_trip(spark, tmp_path):
    io.write_jsonl(docs(spark, 5), str(tmp_path / "d.jsonl"))
    assert sorted(r.doc_id for r in io.read_documents(spark, str(tmp_path / "d.jsonl")).collect()) == [f"d0{k}" for k in range(5)]
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):
        io.read_documents(spark, str(tmp_path / "bad.jsonl")).collect()
    assert io.read_labels(spark, str(tmp_path / "none")).count() == 0
    assert io.save_as_files(docs(spark, 3), str(tmp_path / "files")) == 3 and (tmp_path / "files/unlabeled/d00.txt").exists()
    assert io.unfinished(docs(spark, 3), docs(spark, 2)).first().doc_id == "d02"


def test_templates_are_deterministic(spark):
    a, b = (generate.templates(spark, TAX, 5, seed=3).orderBy("doc_id").collect() for _ in range(2))
    assert a == b and len(a) == 5 * 14 + int(5 * 14 * 0.15) and {r.true_label for r in a} == set(TAX.ids)
    assert not any("{" in r.text for r in a)


# --- review and stream


def test_review_loop(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id string")
    items = queue.build_queue(docs(spark), predictions(spark), None, none, TAX.pairs(spark), size=6, random_ratio=0.5)
    items = spark.createDataFrame(items.collect(), items.schema)
    log = review.LocalLog(tmp_path / "log.jsonl")
    session = review.ReviewSession(items, log, "r", TAX)
    served = review.server(session, port=0)
    threading.Thread(target=served.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{served.server_address[1]}"
    shown = json.load(urllib.request.urlopen(f"{url}/api/items"))["items"]
    blind = next(i for i in shown if i["lane"] == "random")
    assert len(shown) == 6 and blind["model_label"] is None and session.is_blind(blind["doc_id"])
    post = lambda body: urllib.request.urlopen(urllib.request.Request(f"{url}/api/label", json.dumps(body).encode()))
    post({"doc_id": blind["doc_id"], "status": "labeled", "label": "gosi", "lane": "priority", "seconds_spent": 2})
    for bad in ({"doc_id": "zzz", "status": "skipped"}, {"doc_id": blind["doc_id"], "status": "labeled", "label": "made_up"}):
        with pytest.raises(urllib.error.HTTPError) as e:
            post(bad)
        assert e.value.code == 400
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{url}/nothing")
    served.shutdown()
    (r,) = log.records()
    assert r["lane"] == "random" and r["model_label"] is not None and "text" not in r
    assert labels.gold(labels.current(log.table(spark))).count() == 1
    assert len(review.ReviewSession(items, log, "r", TAX).shown) == 5


def test_stream_equals_batch(spark, tmp_path):
    io.write_jsonl(docs(spark, 8), str(tmp_path / "in"))
    words = classify.create_classifier("words", taxonomy=TAX)
    q = route.run(route.documents(spark, str(tmp_path / "in")), words, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = sorted((r.doc_id, r.institution_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.doc_id, r.institution_id) for r in words.predict(docs(spark, 8)).collect()) and len(got) == 8


def test_greedy_choice_by_rounds_equals_the_whole_over_texts(spark, monkeypatch):
    """Rows that come in many rounds, ties in the scores, null and empty texts, and a class that fills up."""
    from sortarium.operators import vectors

    rng = np.random.default_rng(5)
    words = ["river", "stone", "walk", "green", "house", "light", "أرض", "water"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 8))) for _ in range(150)] + ["", None, "river"]
    rows = [(f"d{k:03}", float(rng.integers(0, 4)), str(rng.choice(list("ab"))), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id string, score double, label string, text string").repartition(5)
    monkeypatch.setattr(queue, "_per_round", lambda size: 3)
    weights = vectors.char_vocabulary(df, "text").weigher(vectors.char_grams)
    dense = {}
    for name, _, _, t in rows:
        at, w = weights(t)
        dense[name] = dict(zip(at.tolist(), w.tolist()))
    near = lambda a, b: sum(w * dense[b].get(k, 0.0) for k, w in dense[a].items())
    for cap in (None, 5):
        got = {r.pick: r.doc_id for r in queue.diverse(df, 12, cap).collect()}
        chosen, used, left = [], {}, sorted(rows, key=lambda r: (-r[1], r[0]))
        while left and len(chosen) < 12:
            values = [r[1] - 1.5 * max((near(r[0], c) for c in chosen), default=0.0) for r in left]
            best = max(range(len(left)), key=lambda k: (round(values[k], 9), left[k][1], -k))
            row = left.pop(best)
            if cap and used.get(row[2], 0) >= cap:
                continue
            used[row[2]] = used.get(row[2], 0) + 1
            chosen.append(row[0])
        assert [got[k] for k in sorted(got)] == chosen
    assert queue.diverse(df.limit(0), 5).count() == 0


def test_vectors_are_made_for_the_scores_that_can_win_only(spark, monkeypatch):
    """Texts that share nothing: the best scores win, and the other texts need no vectors; texts that are all alike need them all."""
    monkeypatch.setattr(queue, "_first_band", lambda size: 20, raising=False)
    made, stored = [], queue.session.stored

    def counted(df):
        if "vector" in df.columns:
            made.append(df.count())
        return stored(df)

    monkeypatch.setattr(queue.session, "stored", counted)
    for text, most in (("concat(char(97 + id % 26), char(97 + id div 26 % 26), char(97 + id % 7))", 60), ("'river stone'", 400)):
        df = spark.range(400).selectExpr("id AS doc_id", "1 + id / 1000 AS score", "'a' AS label", f"{text} AS text")
        made.clear()
        got = [r.doc_id for r in queue.diverse(df, 5).orderBy("pick").collect()]
        assert got[0] == 399 and (most == 400 or got == [399, 398, 397, 396, 395]) and sum(made) <= most


def test_grams_by_number_are_those_of_the_lists():
    from collections import Counter

    from sortarium.operators import vectors

    rng = np.random.default_rng(3)
    texts = ["", "a", "a b", "x\x1cy\x85z   q", "A\n\nbc  de\tfghijkl"] + ["".join(rng.choice(list("abأ1 .\n\té\x1c"), 12)) for _ in range(300)]
    for text in map(vectors.T.aggressive_text, texts):
        for low, high in ((2, 5), (3, 5)):
            number, times = vectors.char_numbers(text, low, high)
            assert dict(zip(map(vectors.char_gram, number.tolist()), times.tolist())) == Counter(vectors.char_gram_list(text, low, high))
            assert [vectors.char_number(vectors.char_gram(n)) for n in number.tolist()] == number.tolist()
