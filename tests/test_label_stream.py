"""The label log as a stream against the log as a whole, however it is cut, repeated and interrupted."""

import json
import random

from sortarium import schemas
from sortarium.operators import labels as batch
from sortarium.streaming import labels as stream


def records(n=160, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        status = rng.choice(["labeled", "labeled", "labeled", "skipped", "unclear"])
        out.append({"doc_id": f"d{rng.randrange(25)}", "seq": k, "status": status, "label": rng.choice("ab") if status == "labeled" else "", "lane": rng.choice(schemas.LANES), "model_label": rng.choice(["a", "b", None]), "reviewer": rng.choice("xy"), "seconds_spent": rng.choice([None, 2.5])})
    return out


def written(folder, rows, name):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    (folder / f".{name}").rename(folder / f"{name}.json")


def run(spark, folder, tmp_path, files=1):
    q = stream.run(stream.log(spark, str(folder), files), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert q.exception() is None
    return spark.read.schema(stream.CHANGE).parquet(str(tmp_path / "out"))


def same(spark, changed, rows):
    whole = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schemas.LABEL.split(", ")) for r in rows], schemas.LABEL)
    now = batch.current(whole)
    columns = ["doc_id", "seq", "status", "label", "lane", "model_label", "reviewer", "seconds_spent"]
    assert sorted(map(str, stream.current(changed).select(columns).collect())) == sorted(map(str, now.select(columns).collect()))
    assert sorted(map(str, stream.lanes(changed).collect())) == sorted(map(str, batch.lanes(now).collect()))


def test_any_cut_of_the_log_and_a_restart_give_the_state_of_the_whole(spark, tmp_path):
    rows = records()
    odd = [{"doc_id": None, "seq": 3, "status": "labeled", "label": "a"}, {"doc_id": "d1", "status": "labeled", "label": "a"}]
    mixed = rows[:]
    random.Random(2).shuffle(mixed)  # late records arrive after newer ones
    folder = tmp_path / "log"
    for k, at in enumerate(range(0, 100, 25)):
        written(folder, [*mixed[at : at + 25], *odd], f"a{k}")
    changed = run(spark, folder, tmp_path, files=1)
    same(spark, changed, mixed[:100])
    n = changed.count()
    same(spark, run(spark, folder, tmp_path), mixed[:100])  # nothing new: nothing changes
    assert changed.count() == n
    written(folder, mixed[100:] + mixed[:10], "b")  # some records come twice
    same(spark, run(spark, folder, tmp_path), mixed)


def test_one_batch_equals_many(spark, tmp_path):
    rows = records(90, 5)
    written(tmp_path / "log", rows, "all")
    changed = run(spark, tmp_path / "log", tmp_path, files=100)
    same(spark, changed, rows)
    assert changed.count() == len({r["doc_id"] for r in rows}) and changed.where("was_status IS NOT NULL").count() == 0
