"""The command line from end to end, with a gateway that answers from memory."""

import json

import pytest
from pyspark.sql import functions as F

from sortarium import cli, generate, reporting, taxonomy
from sortarium.operators import classify, evaluate, gateway
from sortarium.sources import documents as io

REPLY = json.dumps({"institution_id": "gosi", "confidence": 0.9, "rationale_ar": "", "alternatives": []})


class Fake:
    """Answers every request; a batch is over as soon as it is submitted. It lies in the folder that the gateway's address names."""

    def __init__(self, folder="", *_):
        self.folder = folder

    def chat(self, **request):
        return REPLY

    def models(self):
        return ["m"]

    def _call(self, path, body=None, once=""):
        from pathlib import Path

        if body is not None:
            Path(self.folder, f"{once}.json").write_text(json.dumps(body["requests"]))
            return {"id": once}
        if "/results" in path:
            # two results a page
            first = int(path.partition("?from=")[2] or 0)
            requests = json.loads(Path(self.folder, f"{path.split('/')[2]}.json").read_text())
            replies = [REPLY, None, "no object"]
            whole = [{"custom_id": r["custom_id"], "content": replies[min(k, 2)]} if k < 3 else {"custom_id": r["custom_id"], "error": "overloaded"} for k, r in enumerate(requests)]
            return {"results": whole[first : first + 2]} | ({"next": f"{path.partition('?')[0]}?from={first + 2}"} if first + 2 < len(whole) else {})
        return {"status": "ended"}


@pytest.fixture
def fake(monkeypatch):
    monkeypatch.setattr(gateway, "HttpClient", Fake)


def test_generate_classify_evaluate_threshold(spark, tmp_path, fake, capsys):
    docs, out, report = str(tmp_path / "docs.jsonl"), str(tmp_path / "out.jsonl"), tmp_path / "report.json"
    assert cli.main(["generate", docs, "--per-class", "2", "--hard-ratio", "0.0", "--noise-ratio", "0"]) == 0
    n = io.read_documents(spark, docs).count()
    assert n == 2 * len(taxonomy.load(None).ids) and cli.main(["taxonomy"]) == 0
    assert cli.main(["classify", docs, out, "--model", "m", "--gateway", "x"]) == 0
    assert {r.institution_id for r in io.read_predictions(spark, out).collect()} == {"gosi"}
    assert cli.main(["evaluate", docs, out, "--out", str(report)]) == 0 and json.loads(report.read_text())["total"] == n
    assert cli.main(["threshold", docs, out, "--per-class"]) == 0 and cli.main(["local", "check", "--model", "m"]) == 0
    said = capsys.readouterr()
    assert "gosi" in said.out and "poorly calibrated" in said.err and '"model_present": true' in said.out
    assert cli.main(["classify", str(tmp_path / "none.jsonl"), out]) == 1 and "error" in capsys.readouterr().err


def test_batches_are_submitted_and_collected(spark, tmp_path, fake, capsys):
    docs, ids, out = str(tmp_path / "docs.jsonl"), str(tmp_path / "ids.json"), str(tmp_path / "out.jsonl")
    cli.main(["generate", docs, "--per-class", "1"])
    (tmp_path / "service").mkdir()
    more = ["--backend", "llm", "--model", "m", "--gateway", str(tmp_path / "service")]
    assert cli.main(["batch", "submit", docs, ids, "--limit", "4", *more]) == 0
    (batch,) = json.loads(open(ids).read())
    assert len(json.loads((tmp_path / "service" / f"{batch}.json").read_text())) == 4
    assert cli.main(["batch", "collect", ids, out, *more]) == 0
    assert io.read_predictions(spark, out).count() == 1
    again = str(tmp_path / "ids.json")
    assert cli.main(["batch", "submit", docs, again, *more]) == 0  # the ledger beside the ids has the first four
    requests = [r["custom_id"] for f in (tmp_path / "service").iterdir() for r in json.loads(f.read_text())]
    assert len(requests) == len(set(requests)) == io.read_documents(spark, docs).count()
    said = capsys.readouterr().err
    assert "leave this machine" in said and "refusal" in said and "unparseable" in said and "overloaded" in said


def test_generators_by_mode(spark, tmp_path, fake):
    tax = taxonomy.load(None)
    corpus = [{"id": f"c{k}", "label": i, "text": f" text {i} ", "difficulty": "hard" if k % 2 else "plain", "pair": "p"} for k, i in enumerate(tax.ids)]
    (tmp_path / "corpus_part1.json").write_text(json.dumps(corpus))
    whole, hard, model = (str(tmp_path / f"{x}.jsonl") for x in ("whole", "hard", "model"))
    assert cli.main(["generate", whole, "--mode", "curated", "--corpus", str(tmp_path), "--noise-ratio", "0"]) == 0
    assert cli.main(["generate", hard, "--mode", "curated", "--corpus", str(tmp_path), "--hard-only"]) == 0
    assert cli.main(["generate", model, "--mode", "model", "--per-class", "1"]) == 0
    n = len(tax.ids)
    assert [io.read_documents(spark, p).count() for p in (whole, hard, model)] == [n, n // 2, n]
    page = reporting.corpus_viewer(generate.curated(spark, tax, str(tmp_path)).withColumnRenamed("true_label", "label"), limit=3)
    assert '"shown": 3' in page.replace("&quot;", '"') and f'"documents": {n}' in page.replace("&quot;", '"') and "id=p" in page


def test_difficulty_of_sets(spark):
    class Known:
        def fit(self, docs):
            return self

        def predict(self, docs):
            return docs.select("doc_id", F.lit("a").alias("institution_id"), F.lit(0.5).alias("confidence"), F.lit(False).alias("needs_review"))

    made = lambda labels: spark.createDataFrame([(str(k), "t", x) for k, x in enumerate(labels)], "doc_id string, text string, true_label string")
    dimension = spark.createDataFrame([("a", 0), ("b", 1)], "institution_id string, ord int")
    out = evaluate.difficulty(Known(), made("ab"), {"easy": made("aa"), "hard": made("abbb")}, dimension).collect()
    assert [(r.set, r.total, r.accuracy) for r in out] == [("easy", 2, 1.0), ("hard", 4, 0.25)]


def test_ocr_failures_have_one_name():
    class Broken:
        def __init__(self, error):
            self.error = error

        def chat(self, **_):
            raise self.error

        create = chat

    for error in (gateway.GatewayUnavailable("down"), gateway.GatewayError("no"), OSError("x")):
        with pytest.raises(io.OCRUnavailable):
            io.GatewayOcr(Broken(error)).transcribe([b""])
    with pytest.raises(io.OCRUnavailable):
        io.HostedOcr(lambda: Broken(PermissionError("key"))).transcribe([b""])
    with pytest.raises(ConnectionError):
        io.HostedOcr(lambda: Broken(ConnectionError("net"))).transcribe([b""])
    with pytest.raises(io.OCRUnavailable):
        io.ocr_backend("hosted").transcribe([b""])

    class Fine:
        def create(self, **request):
            return {"content": [{"type": "text", "text": f"{len(request['messages'][0]['content'])} parts "}]}

    assert io.HostedOcr(Fine).transcribe([b"", b""]) == "3 parts"


def test_folders_are_known_whatever_their_name(spark, tmp_path):
    folder = tmp_path / "scans.d"
    folder.mkdir()
    (folder / "one.txt").write_text("hello")
    assert [r.doc_id for r in io.read_documents(spark, str(folder)).collect()] == ["one"]
    (tmp_path / "x.odd").write_text("")
    with pytest.raises(io.UnsupportedDocument):
        io.read_documents(spark, str(tmp_path / "x.odd"))
    assert "local" in classify.available_backends()
