"""Every operator against a plain version of its definition, and on odd inputs."""

import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sortarium.llm import bpe, common, licenses, mixing, neardup, quality, tiff, toolcalls, topk, toxicity, urlfilter
from sortarium.llm.common import Scratch, kth_largest, portions, shared_dir, word_hashes
from sortarium.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, key string"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", f"src{k % 3}", len(t or ""), "x", "y") for k, t in enumerate(texts)], DOCS)


ODD = ["", None, " \n ", "same words in every one of these", "same words in every one of these", "a" * 70_000, "x " * 30_000, "İK ﬁ \x00 é"]


# --- shared parts


def test_word_hashes_equal_words_and_only_those():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab 1.é\n_") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["q" * 140_000 + " w", "z " * 90_000]
    for symbols in (False, True):
        h, at, _ = word_hashes(texts, symbols=symbols)
        pattern = r"[a-z0-9é]+|[!-/:-@\[-`{-~]+" if symbols else r"[a-z0-9é]+"
        words = [(k, w) for k, t in enumerate(texts) for w in re.findall(pattern, t)]
        assert at.tolist() == [k for k, _ in words]
        seen = {}
        assert all(seen.setdefault(w, x) == x for x, (_, w) in zip(h.tolist(), words)) and len(set(seen.values())) == len(seen)


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.randint(-50, 50) for _ in range(200)] + [10**15]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 100, 201):
        v, above = kth_largest(df, "v", k, bins=4)
        assert v == sorted(values, reverse=True)[k - 1] and above == sum(x > v for x in values)
    assert kth_largest(df, "v", 0) is None and kth_largest(df.limit(0), "v", 1) is None


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (4, 4), *[(20 + k, 21 + k) for k in range(12)]]
    scratch = Scratch(spark)
    odd = [*links, *links[:3], (None, 1), (4, None)]
    got = {r.node: r["class"] for r in components(spark.createDataFrame(odd, "a long, b long").withColumn("class", F.lit(0)), scratch).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 4: 4} | {20 + k: 20 for k in range(13)}
    assert components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0
    assert os.path.isdir(scratch.root)
    scratch.close()
    assert not os.path.exists(scratch.root) and os.path.isdir(shared_dir(spark).removeprefix("file:"))


def test_portions():
    texts = ["a" * n for n in (5, 5, 90, 1, 0, 1)] + [None, "b"]
    got = [(p.start, p.stop) for p in portions(texts, 3, 20)]
    assert got == [(0, 2), (2, 3), (3, 6), (6, 8)] and list(portions([], 3)) == []


# --- 1 and 2: learnt scores


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    good = lambda: " ".join(rng.choice(["river", "stone", "green", "walk", "light", "house", "tree"]) for _ in range(40))
    rows = []
    for k in range(n):
        bad, toxic = k % 4 == 0, k % 6 == 1
        text = "BUY!! NOW!! CHEAP!! " * 12 if bad else good()
        rows.append((k, text + (" you awful nitwit" if toxic else ""), int(not bad), int(toxic)))
    return rows


def test_quality_keeps_good_texts_and_drops_others(spark):
    rows = corpus()
    docs = frame(spark, [t for _, t, *_ in rows])
    labels = spark.createDataFrame([(k, q) for k, _, q, _ in rows if k % 2 == 0 or k % 3 == 0], "doc_id long, quality int")
    out = {r.doc_id: r.selected for r in quality.resample(docs, labels, quality.Settings(smoothing=5.0)).collect()}
    assert all(out[k] == bool(q) for k, _, q, _ in rows)
    half = quality.resample(docs, labels, quality.Settings(smoothing=5.0, keep=0.25)).where("selected")
    assert half.count() == 60 and half.where("text LIKE 'BUY%'").count() == 0


def test_quality_weights_do_not_depend_on_the_size(spark):
    rows = corpus()
    made = lambda times: (frame(spark, [t for _, t, *_ in rows] * times), spark.createDataFrame([(k + m * len(rows), q) for m in range(times) for k, _, q, _ in rows], "doc_id long, quality int"))
    small, large = (quality.fit(*made(times)) for times in (1, 20))
    used = quality.counts(made(1)[0], quality.Settings().bits) > 0
    assert np.abs(small[used] - large[used]).max() < 0.2 and small[used].min() < -1.5


def test_gumbel_draws_follow_the_weights(spark):
    """Two weights, one draw of many: the shares are those of the weights."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, math.log(3.0)).otherwise(0.0).alias("log_weight"))
    keyed = quality.gumbel_keys(rows, 5).withColumn("pair", F.floor(F.col("doc_id") / 2))
    first = keyed.groupBy("pair").agg(F.max_by("doc_id", "gumbel_key").alias("w")).where("w % 2 = 0").count() / 2000
    assert first == pytest.approx(0.75, abs=0.04)


def test_toxicity_is_learnt_held_out(spark):
    rows = corpus()
    docs = frame(spark, [t for _, t, *_ in rows])
    labels = spark.createDataFrame([(k, t) for k, _, _, t in rows], "doc_id long, toxic int")
    s = toxicity.Settings(bits=16, l1=0.5)
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()), s)
    assert 0 < len(model[0]) < 3000
    out = {r.doc_id: r.score for r in toxicity.score(docs, model, s).collect()}
    held = [k for k in out if zlib.crc32(str(k).encode()) % 5 == 0]
    assert held and all((out[k] >= 0.5) == bool(rows[k][3]) for k in held) and all(0 <= v <= 1 for v in out.values())


def test_ftrl_equals_a_plain_version():
    """The update rule coordinate by coordinate, in dictionaries."""
    rng = random.Random(22)
    rows = [np.array(sorted(rng.sample(range(40), rng.randint(0, 9))), np.int64) for _ in range(120)]
    labels = np.array([float(7 in r or rng.random() < 0.1) for r in rows])
    s = toxicity.Settings(bits=6, l1=0.3, l2=0.5, alpha=0.7, beta=0.9, epochs=2)
    z, n, bz, bn = {}, {}, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)
    draw = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for k in draw.permutation(len(rows)):
            w, b = {int(i): weight(int(i)) for i in rows[k]}, -bz / ((s.beta + math.sqrt(bn)) / s.alpha)
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - labels[k]
            for i in w:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / s.alpha * w[i]
                n[i] = old + g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / s.alpha * b
            bn += g * g
    got, bias = toxicity.ftrl(rows, labels, s)
    assert np.allclose(got, [weight(i) for i in range(64)]) and bias == pytest.approx(-bz / ((s.beta + math.sqrt(bn)) / s.alpha)) and 0 < (got != 0).sum() < 40


def test_toxicity_features_are_the_grams_of_the_definition():
    rng = random.Random(23)
    texts = [" ".join(rng.choice(["awful", "nit", "nitwit", "you", "extraordinary", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(50)] + [None, "", "...", "One,TWO"]
    every = {}
    for text, found in zip(texts, toxicity.features(texts, toxicity.Settings(bits=40))):
        w = re.findall("[a-z0-9\x80-\uffff]+", (text or "").lower())
        raw = [x.encode() for x in w]
        grams = {("u", x) for x in w} | {("s", n, x[:n]) for x in raw for n in (4, 5) if len(x) > n} | {(g, a, b) for g in (1, 2) for a, b in zip(w, w[g:])}
        assert len(found) == len(grams)
        for b in found.tolist():
            every.setdefault(b, set(grams)).intersection_update(grams)
    assert all(every.values())


def test_learnt_models_bound_their_sample_and_take_odd_ids(spark):
    rows = corpus()
    docs = frame(spark, [t for _, t, *_ in rows]).unionByName(frame(spark, ["you awful nitwit"]).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.unionByName(docs.limit(30))
    labels = spark.createDataFrame([(k, t, q) for k, _, q, t in rows] + [(None, 1, 1), (3, None, None)] + [(k, t, q) for k, _, q, t in rows[:9]], "doc_id long, toxic int, quality int")
    s = toxicity.Settings(bits=16, l1=0.5)
    out = toxicity.score(docs, toxicity.fit(docs, labels, s), s).withColumn("held_out", toxicity.held_out()).collect()
    assert len(out) == docs.count() and all(r.held_out in (True, False) for r in out) and all(r.score > 0.5 for r in out if r.doc_id is None)
    few = toxicity.fit(docs, labels, toxicity.Settings(bits=16, l1=0.5, max_features=1))
    assert len(few[0]) == 0 and few[2] == 0
    kept = quality.resample(docs.withColumn("selected", F.lit("theirs")), labels, quality.Settings(keep=0.5))
    assert kept.columns.count("selected") == 1
    by_id = kept.groupBy("doc_id").agg(F.count_distinct("selected").alias("n")).where("n > 1").count()
    assert by_id == 0 and abs(kept.where("selected").count() - docs.count() / 2) <= 2


def test_log_weights_equal_plain_counts(spark):
    """Sums of log ratios over n-grams counted by Python, with buckets enough for each to have its own."""
    from collections import Counter

    rng = random.Random(24)
    word = lambda: rng.choice(["river", "Stone", "x1", "!!", "#", "lamp", "lamp"])
    texts = [" ".join(word() for _ in range(rng.randint(0, 9))) for _ in range(40)] + [None]
    good = {k for k in range(41) if k % 3 == 0}

    def grams(t):
        w = re.findall(r"[A-Za-z0-9]+|[!#]+", t or "")
        return w + [("again",) if a == b else (a, b) for a, b in zip(w, w[1:])]

    raw, target = Counter(g for t in texts for g in grams(t)), Counter(g for k in good for g in grams(texts[k]))
    total, n, mass = sum(raw.values()), sum(target.values()), 0.15 * sum(target.values())
    want = [sum(math.log((target[g] + mass * raw[g] / total) / ((n + mass) * raw[g] / total)) for g in grams(t)) for t in texts]
    labels = spark.createDataFrame([(k, int(k in good)) for k in range(41)], "doc_id long, quality int")
    docs, s = frame(spark, texts), quality.Settings(bits=22)
    got = [r.log_weight for r in quality.weigh(docs, quality.fit(docs, labels, s), s).orderBy("doc_id").collect()]
    assert np.allclose(got, want)


def test_learnt_scores_on_odd_rows(spark):
    docs, none = frame(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    q = quality.resample(docs, none).collect()
    assert len(q) == len(ODD) and {r.log_weight for r in q} == {0.0} and all(r.selected for r in q)
    model = toxicity.fit(docs, none)
    out = toxicity.score(docs, model).collect()
    assert {r.score for r in out} == {0.5} and out[0].key == "y"
    empty = docs.limit(0)
    assert quality.resample(empty, none).count() == 0 and toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


# --- 10


def plain_classes(texts, least=0.8):
    from collections import Counter

    bags = []
    for t in texts:
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        bags.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] is None or bags[j] is None:
                near = bags[i] is bags[j] and (texts[i] or "") == (texts[j] or "")
            else:
                near = sum((bags[i] & bags[j]).values()) >= least * sum((bags[i] | bags[j]).values())
            if near:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {k: root(k) for k in range(len(texts))}


def near_texts(seed=11):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randint(0, 40))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(rng.choice([1, 3, 8])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    out += ["again " * 50, "again " * 49, "again " * 20, "one two", "One, two!", "", None, "***", "***", "!!!"]
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = near_texts()
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, texts)).collect()}
    assert got == plain_classes(texts)
    kept = neardup.deduplicated(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and kept.columns == frame(spark, []).columns


def test_near_duplicates_on_odd_rows(spark):
    docs = frame(spark, ODD)
    both = docs.unionByName(docs.limit(1)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    kept = neardup.deduplicated(both)
    assert kept.where("doc_id IS NULL").count() == 2 and kept.where("doc_id = 0").count() == 1 and kept.where("doc_id IN (3, 4)").count() == 1
    assert neardup.classes(docs.limit(0)).count() == 0


def test_near_duplicates_where_ids_repeat_with_other_texts(spark):
    """Every text of a repeated id is compared and links its class, against brute force over the texts."""
    base = lambda c: [f"{c}{k}" for k in range(120)]
    near = lambda c: " ".join([*base(c)[:60], "changed", *base(c)[61:]])
    a, b, c, d = (" ".join(base(x)) for x in "abcd")
    rows = [(5, a), (5, b), (7, b), (12, near("b")), (20, a), (21, near("c")), (30, b), (30, c), (30, d), (31, near("d")), (40, "alone " * 9), (41, "words " * 9), (41, "~~"), (42, "~~"), (2**63 - 1, near("a")), (-3, "far " * 8), (-3, None), (50, "")]
    rows += [(100 + k % 7, t) for k, t in enumerate(near_texts(seed=12))]
    texts = plain_classes([t for _, t in rows])
    up = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for k, (i, _) in enumerate(rows):
            for j, _ in (rows[m] for m in texts if texts[m] == texts[k]):
                low = min(up[i], up[j])
                changed |= up[i] != low or up[j] != low
                up[i] = up[j] = low
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == up
    assert up[12] == up[7] == up[5] == up[31] == up[21] and up[42] == 41 and up[40] == 40
    assert sorted(r.doc_id for r in neardup.deduplicated(docs).collect()) == sorted(set(up.values()))


def test_signatures_are_unbiased():
    a = {k: 1 + k % 4 for k in range(40)}
    b = {k: v + (k % 3 == 0) for k, v in a.items() if k % 5} | {99: 9}
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
    element, weight, owner = np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), np.array([0] * len(a) + [1] * len(b))
    seen = [(lambda g: (g[0] == g[1]).mean())(neardup.bag_minhash(neardup.mix(element), weight, owner, 2, 192, s)) for s in range(40)]
    assert np.mean(seen) == pytest.approx(true, abs=0.02)


def test_blocks_find_what_leaders_miss(spark):
    """A chain whose ends differ: only neighbours are near, and a bucket's leader is near to few."""
    rng = random.Random(5)
    words, texts = [f"w{k}" for k in range(200)], []
    for k in range(14):
        texts.append(" ".join(words))
        at = rng.randrange(180)
        words[at : at + 3] = [f"n{k}a", f"n{k}b", f"n{k}c"]
    for s in (neardup.Settings(block=300), neardup.Settings(worth=2.0)):
        got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, texts), s).collect()}
        assert got == plain_classes(texts)


def test_every_pair_of_a_bucket_is_compared(spark):
    """Cells link all near duplicates of different classes that share a bucket, however the blocks fall."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.choice([1, 2, 4, 9])):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    s = neardup.Settings()
    run, times, place = neardup.shingles(texts, 5)
    signature = neardup.bag_minhash(run, times, place, 60, 192, s.seed)
    sketch = (neardup.mix(signature.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)
    named = [0 if rng.random() < 0.5 else k for k in range(60)]
    # All share the keys 7 and 9; the second band has buckets of its own.
    rows = [(key, k, 116, named[k], [100 + k, 7, 200 + k, 9], sketch[k].tobytes(), texts[k]) for k in range(60) for key in (7, 9)]
    df = spark.createDataFrame(rows, "key long, rep long, n long, class long, bands array<long>, sketch binary, text string")
    bags = [{tuple(t.split()[k : k + 5]) for k in range(116)} for t in texts]

    def joined(links):
        up = {k: k for k in range(60)}
        for _ in range(60):
            for a, b in links:
                up[a] = up[b] = min(up[a], up[b])
        return up

    want = joined([(a, b) for a in range(60) for b in range(a) if named[a] != named[b] and len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b])])
    for block in (10**6, 3000, 700):
        got = [(r.a, r.b) for r in neardup.resembling(df, neardup.Settings(block=block)).collect()]
        assert joined(got) == want and len(set(want.values())) < 60 and all(named[a] != named[b] for a, b in got)


def test_recall_of_pairs_just_near_enough(spark):
    """Thousands of texts, each with one variant at a similarity from 0.80 to 0.85, against brute force over the variants."""
    from collections import Counter

    rng, texts = random.Random(21), []
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    while len(texts) < 4000:
        words = [f"{rng.randrange(10**6):x}" for _ in range(rng.randint(60, 140))]
        other = list(words)
        while True:
            other[rng.randrange(len(other))] = f"{rng.randrange(10**6):x}"
            a, b = bag(words), bag(other)
            like = sum((a & b).values()) / sum((a | b).values())
            if like < 0.85:
                break
        if like >= 0.8:
            texts += [" ".join(words), " ".join(other)]
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, texts)).collect()}
    found = sum(got[k] == got[k + 1] == k for k in range(0, len(texts), 2))
    assert found >= 0.999 * len(texts) / 2 and len(set(got.values())) >= len(texts) / 2


# --- 4


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in rng.normal(size=10)] for _ in range(150)]
    vectors[7] = vectors[8] = vectors[60]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(200, None), (201, [1.0, None] + [0.0] * 8), (202, [float("nan")] * 10), (203, [1.0, 2.0]), (None, [0.0] * 10), (60, vectors[60])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, topk.Settings(segments=(0.2, 0.5, 0.9), block=3, tile=2, rows=16)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    q = {k: [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (10 - len(v)) for k, v in enumerate(vectors)} | {203: [256, 512] + [0] * 8}
    for k in range(0, 150, 20):
        best = sorted(((-sum(a * b for a, b in zip(q[k], v)), i) for i, v in q.items() if i != k))[:5]
        assert got[k] == [(i, -s) for s, i in best]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0 and topk.top_k(df.limit(3), F.lit(True)).count() == 6


def test_top_k_bounds_hold_and_prune():
    """No bound lies below the product; with clusters in few directions most pairs fall before the exact product."""
    rng = np.random.default_rng(8)
    x = np.floor(256 * (rng.normal(size=(20, 24))[rng.integers(0, 20, 3000)] + 0.2 * rng.normal(size=(3000, 24)))).astype(np.int64)
    q, s = x[::50], topk.Settings(rows=500, tile=7)
    turned = topk.compacting(q)
    for share in (0.1, 0.25, 0.5, 0.75, 1.0):
        bound = topk.statistics(q @ turned, share) @ topk.statistics(x @ turned, share).T
        assert (bound >= q @ x.T - 1e-6).all() and (share < 1 or np.allclose(bound, q @ x.T))
    best = topk.Best(np.arange(0, 3000, 50), q, s)
    for k in range(0, 3000, 500):
        best.add(np.arange(k, k + 500), x[k : k + 500])
    assert best.left[0] == 60 * 3000 and (np.diff(best.left) <= 0).all() and best.left[-1] < 0.2 * best.left[0]
    for i in range(60):
        want = sorted((-int(v), j) for j, v in enumerate(x @ q[i]) if j != 50 * i)[:5]
        mine = best.rows[0] == i
        assert list(zip((-best.rows[2][mine]).tolist(), best.rows[1][mine].tolist())) == want


def test_top_k_leaves_out_what_a_long_cannot_hold(spark):
    rows = [(0, [1e30, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 0.5]), (3, [-1e30, 1.0]), (50, [3.0, 1.0]), (4, [8e6, 8e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "score": F.lit("x")})
    out = topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in out] == [(50, 4, 65536 * 32 * 10**6), (50, 2, 65536 * 13 // 2), (50, 1, 65536 * 4)]


# --- 3, 5, 6


def test_tool_calls(spark):
    import json

    call = lambda i, n, a: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a}]})
    done = lambda i: json.dumps({"tool_call_id": i, "content": "ok"})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call("a", "search", {"query": "é \"q\"", "limit": 3})), (1, 2, "tool", done("a")),
        (1, 3, "assistant", call("b", "search", {"query": "$a", "nope": 1})), (1, 4, "assistant", call("c", "count", {"words": "x", "after": "$b"})), (1, 5, "tool", done("c")),
        (2, 0, "assistant", call("a", "translate", {"target": "en"})), (2, 1, "assistant", call("d", "search", {"query": "$e"})), (2, 2, "assistant", call("e", "search", {"query": "$d"})),
        (3, 0, "tool", done("z")), (3, 1, "assistant", call("z", "none", {})), (3, 2, "assistant", call("z", "count", {"words": ["b", "a"], "exact": True})), (3, 3, "assistant", None), (3, 4, "assistant", '{"tool_calls": nonsense'), (None, 0, "assistant", call("q", "search", {})),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.turn): r for r in toolcalls.linked(df, toolcalls.tools_table(spark)).collect()}
    assert len(out) == 8
    assert (out[1, 1].status, out[1, 1].level, out[1, 1].result_turn, out[1, 1].valid) == ("linked", 0, 2, True)
    assert out[1, 1].canonical == '{"arguments":{"limit":3,"query":"é \\"q\\""},"id":"a","name":"search","result":"ok"}'
    assert (out[1, 3].status, out[1, 3].level, out[1, 3].errors) == ("no result", 1, "unknown nope")
    assert (out[1, 4].level, out[1, 4].errors) == (2, "type words") and out[2, 0].errors == "missing text"
    assert out[2, 1].level is None is out[2, 2].level
    assert out[3, 1].status == out[3, 2].status == "repeated id" and out[3, 1].errors == "no such tool" and out[3, 2].valid
    assert toolcalls.linked(df.limit(0), toolcalls.tools_table(spark)).count() == 0


def test_types_of_all_parameters_are_held(spark):
    import json

    names = [f"p{k:05}" for k in range(10_002)] + ["it's", "z"]
    tools = spark.createDataFrame([("t", n, "BIGINT", False) for n in names], toolcalls.TOOLS_SCHEMA)
    given = [{"p00001": "x", "p10001": "x", "z": None, "it's": [1]}, {"p10001": 1, "z": 2, "it's": 3}]
    found = spark.createDataFrame([(k, "t", json.dumps(g)) for k, g in enumerate(given)], "k long, tool string, arguments string")
    assert [r.errors for r in toolcalls.validation(found, tools).orderBy("k").collect()] == ["type it's; type p00001; type p10001; type z", ""]


def test_nested_schemas(spark):
    import json

    schema = [
        ("t", "a", "object", True, None), ("t", "a.b", "integer", True, None), ("t", "a.c", "string", False, ['"x"', '"y"']), ("t", "a.d", "array", False, None), ("t", "a.d[]", "object", False, None), ("t", "a.d[].e", "number", True, None),
        ("t", "free", "object", False, None), ("t", "x\\.y", "boolean", False, None), ("t", "m", "array", False, None), ("t", "m[]", "array", False, None), ("t", "m[][]", "null", False, None), ("u", None, None, None, None), (None, "q", "string", True, None),
    ]
    tools = spark.createDataFrame(schema, "tool string, parameter string, type string, required boolean, enum array<string>")
    given = [
        ("t", {"a": {"b": 3.0, "c": "x", "d": [{"e": 1.5}, {"e": 2}]}, "free": {"any": [1]}, "x.y": True, "m": [[None], []]}, ""),
        ("t", {}, "missing a"), ("t", {"a": {}}, "missing a.b"), ("t", {"a": {"b": 1.5, "c": "z", "no": 1}}, "enum a.c; type a.b; unknown a.no"),
        ("t", {"a": {"b": 1, "d": [{"e": "s"}, {}, 7]}}, "missing a.d[].e; type a.d[]; type a.d[].e"), ("t", {"a": 5}, "type a"), ("t", {"a": {"b": 1}, "free": [], "x.y": 1, "x": {"y": 1}}, "type free; type x\\.y; unknown x"),
        ("t", {"a": {"b": 10**15}, "m": [[1], "s"]}, "type m[]; type m[][]"), ("u", {}, ""), ("u", {"a": 1}, "unknown a"), ("v", {}, "no such tool"), ("t", [1], "no object"), (None, {}, "no such tool"),
    ]
    rows = [(k, n, json.dumps(g)) for k, (n, g, _) in enumerate(given)] + [(90, "t", None), (91, "t", "{nonsense")]
    found = spark.createDataFrame(rows, "k long, tool string, arguments string")
    out = {r.k: r.errors for r in toolcalls.validation(found.unionByName(found.where("k = 3")), tools).collect()}
    assert out == {k: e for k, (*_, e) in enumerate(given)} | {90: "no object", 91: "no object"}
    assert toolcalls.validation(found.limit(0), tools).count() == 0 and {r.errors for r in toolcalls.validation(found, tools.limit(0)).collect()} == {"no such tool"}


def plain_levels(uses):
    out, changed = {}, True
    while changed:
        changed = False
        for c, needs in uses.items():
            needs = [n for n in needs if n in uses]
            if c not in out and all(n in out for n in needs):
                out[c], changed = 1 + max((out[n] for n in needs), default=-1), True
    return out


def test_levels_equal_brute_force(spark):
    rng = random.Random(13)
    uses = {}
    for conv in range(12):
        n = rng.choice([1, 5, 40])
        for k in range(n):
            kind = rng.random()
            uses[conv, k] = {(conv, rng.randrange(n) if kind < 0.05 else rng.randrange(k)) for _ in range(rng.choice([1, 1, 1, 2, 3]))} if k and kind < 0.85 else {(conv, 999)} if kind > 0.97 else set()
    for k in range(300):
        uses[50, k] = {(50, k - 1)} if k else set()
    for k in range(4):
        uses[51, k] = {(51, (k + 1) % 4)}
    rows = [(c, str(k), [str(u) for _, u in us]) for (c, k), us in uses.items()]
    found = spark.createDataFrame(rows, "conv_id long, call_id string, uses array<string>")
    got = {(r.conv_id, int(r.call_id)): r.level for r in toolcalls.levels(found).collect()}
    assert got == plain_levels(uses) and got[50, 299] == 299 and (51, 0) not in got


def test_registered_tool_calls_equal_a_plain_version(spark):
    """The query's own steps over a small table, against Python's json and a walk over each conversation."""
    import json

    rng, turns = random.Random(14), []
    for c in range(9):
        for t in range(rng.choice([1, 2, 9, 24])):
            text = rng.choice([None, "", "a \"b\" é\n$c2 \\ x", 'He paid "$5" for it', "$100 off today", "$c0 $c2 \\$c4 $c900 $", "word " * rng.randint(1, 400), "tabs\tand   blanks"])
            turns.append((c, t, "assistant" if t % 2 else "user", text))
    turns += turns[:3] + [(None, 0, "user", "x"), (3, 2, "system", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = toolcalls.linked(toolcalls.as_tool_messages(df.withColumn("tool", F.lit(1))), toolcalls.tools_table(spark)).collect()
    calls, replies, repeated = [], {}, {}
    for c, t, role, text in turns:
        text, name, odd = text or "", ("search", "translate", "count")[t // 2 % 3], t % 7 == 6
        if c is None:
            continue
        if role == "user":
            after = {"after": f"$c{t - 2}"} if t >= 4 and t % 8 else {}
            given = {"search": {**({} if odd else {"query": text}), "limit": len(text), **after}, "translate": {"target": "en", "text": text, **({"extra": 1} if odd else {})}, "count": {"words": text.split(" "), **({"exact": 1} if odd else {}), **after}}[name]
            errors = {"search": "missing query", "translate": "unknown extra", "count": "type exact"}[name] if odd else ""
            calls.append((c, t, name, given, errors))
            repeated[c, t] = repeated.get((c, t), 0) + 1
        elif role == "assistant":
            replies[c, t - 1] = min(replies.get((c, t - 1), (t, "~")), (t, __import__("hashlib").md5(text.encode()).hexdigest()))
    uses = {}
    for c, t, _, given, _ in calls:
        strings = [x for v in given.values() for x in (v if isinstance(v, list) else [v]) if isinstance(x, str)]
        uses.setdefault((c, f"c{t}"), set()).update((c, x[1:]) for x in strings if x.startswith("$"))
    level = plain_levels(uses)
    want = []
    for c, t, name, given, errors in calls:
        turn, content = replies.get((c, t), (None, None))
        whole = {"arguments": given, "id": f"c{t}", "name": name, **({"result": content} if content else {})}
        status = "repeated id" if repeated[c, t] > 1 else "no result" if turn is None else "linked"
        want.append((c, t, name, turn, status, level.get((c, f"c{t}")), errors, json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
    got = [(r.conv_id, r.turn, r.tool, r.result_turn, r.status, r.level, r.errors, r.canonical) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str) and len({r[4] for r in want}) == 3


def test_references_are_whole_values_and_numbers_are_exact(spark):
    import json

    given = [
        ('{"query":"He paid \\"$a\\" for it"}', []), ('{"query":"$100 off today"}', ["100 off today"]), ('{"$a" : "x", "q": {"$b":["$a", {"y":"$q \\\\ \\"z\\""}]}}', ["a", 'q \\ "z"']),
        ('{"x":"\\\\","y":"$a"}', ["a"]), ('{"x":"\\\\\\"","y":"$b\\u0041"}', ["bA"]), ('{"x":"$"}', []), (None, None), ("nonsense", []), ('{"x": "$a" , "y" : 1}', ["a"]),
    ]
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(given)], "k int, arguments string")
    got = {r.k: r.uses for r in df.select("k", toolcalls.references("arguments").alias("uses")).collect()}
    assert got == {k: u for k, (_, u) in enumerate(given)}
    whole = lambda a: '{"tool_calls":[{"id":"a","name":"search","arguments":' + a + "}]}"
    rows = [(1, 0, "assistant", whole('{"query":"$100 off today"}')), (2, 0, "assistant", whole('{"query":"$a"}')), (3, 0, "assistant", whole('{"limit":' + "1" * 50 + "}")), (4, 0, "assistant", whole('{"limit":' + "1" * 38 + ',"query":"' + "2" * 60 + '"}')), (5, 0, "assistant", whole('{"query":"x","limit":-' + "1" * 39 + "}")), (6, 0, "assistant", whole('{"query":"x","query":"y"}'))]
    out = {r.conv_id: r for r in toolcalls.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), toolcalls.tools_table(spark)).collect()}
    assert [out[k].level for k in (1, 2)] == [0, None]
    assert [(out[k].errors, out[k].canonical) for k in (3, 5, 6)] == [("number too long", None)] * 2 + [("no object", None)]
    assert out[4].valid and json.loads(out[4].canonical)["arguments"]["limit"] == int("1" * 38)


def test_tool_messages_hold_the_whole_text(spark):
    import json

    long = ("a word and more " * 20).strip()
    turns = [(c, t, "user", long + end) for c, end in ((1, " x"), (2, " y")) for t in (0, 2, 4)]
    made = toolcalls.as_tool_messages(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    arguments = {(r.conv_id, r.turn): json.loads(r.arguments) for r in toolcalls.calls(made).collect()}
    for c, end in ((1, " x"), (2, " y")):
        assert arguments[c, 0]["query"] == long + end and arguments[c, 2]["text"] == long + end and arguments[c, 4]["words"] == (long + end).split(" ")
    out = toolcalls.linked(made, toolcalls.tools_table(spark)).collect()
    assert len({r.canonical for r in out}) == len(out) == 6 and all(r.valid for r in out)


def test_url_lists_in_time(spark):
    log = spark.createDataFrame([("s", "domain", "Bad.org", "add", "2024-02-01", 1), ("s", "domain", "bad.org", "remove", "2024-03-01", 2), ("s", "prefix", "ok.org/x/y", "add", "2024-01-01", 3), ("allow", "host", "in.bad.org", "add", "2024-02-15", 4), (None, "host", "q", "add", "2024-01-01", 5)], urlfilter.LOG_SCHEMA)
    cases = [
        ("http://bad.org/", "2024-01-31", False), ("http://a.bad.org:80/z?q", "2024-02-01", True), ("HTTPS://u:p@BAD.ORG", "2024-02-29", True), ("http://bad.org/", "2024-03-01", False), ("http://notbad.org/", "2024-02-10", False),
        ("http://in.bad.org/", "2024-02-10", True), ("http://in.bad.org/", "2024-02-20", False), ("http://ok.org/x/y/z", "2024-05-05", True), ("http://ok.org/x/yz", "2024-05-05", False), (None, "2024-02-10", False), ("nonsense", "2024-02-10", False), ("http://bad.org/", None, False),
    ]
    df = spark.createDataFrame([(k, u, d, "theirs") for k, (u, d, _) in enumerate(cases)], "page_id long, url string, fetched string, host string")
    out = urlfilter.filtered(df.unionByName(df), log).collect()
    assert len(out) == 2 * len(cases) and all(r.blocked == cases[r.page_id][2] for r in out)
    assert urlfilter.filtered(df, log.limit(0)).where("blocked").count() == 0 and urlfilter.filtered(df.limit(0), log).count() == 0


def test_url_lists_beside_columns_of_any_name_and_large_logs(spark, monkeypatch):
    log = spark.createDataFrame([("s", "domain", "bad.org", "add", "2024-02-01", 1), ("t", "domain", "org", "add", "2024-02-01", 2), ("allow", "host", "ok.org", "add", "2024-01-01", 3)], urlfilter.LOG_SCHEMA)
    rows = [(k, f"http://{h}/x{k % 3}", "2024-03-01") for k, h in enumerate(["bad.org", "a.bad.org", "ok.org", "other.com", "fine.org"] * 8)]
    theirs = ["u", "t", "found", "key", "h", "p", "c", "of", "row", "salt", "kind", "Lists", "a.b"]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched string").withColumns({c: F.lit(f"their {c}") for c in theirs})
    want = {"bad.org": ("s,t", True), "a.bad.org": ("s,t", True), "ok.org": ("allow,t", False), "other.com": ("", False), "fine.org": ("t", True)}
    for entries in (100, 0):
        monkeypatch.setattr(urlfilter, "BROADCAST_ENTRIES", entries)
        out = urlfilter.filtered(df, log)
        assert out.columns == ["page_id", "url", "fetched", *(c for c in theirs if c != "Lists"), "host", "lists", "blocked"]
        got = out.collect()
        assert len(got) == len(rows) and all((r.lists, r.blocked) == want[r.host] and r.found == "their found" and r["a.b"] == "their a.b" for r in got)


def test_licenses(spark):
    texts = [
        "Released under the MIT License.", "SPDX-License-Identifier: GPL-3.0-or-later", "cc by nc cc by nc", "Licensed under the Apache License, Version 2.0 and under the MIT license", "a mit-igated license agreement", *ODD,
        "This work is licensed under the GNU General Public License, version 3.",
    ]
    out = sorted(licenses.scan(frame(spark, texts)).collect(), key=lambda r: r.doc_id)
    word, up = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for t, r in zip(texts, out):
        w = word.findall((t or "").translate(up))
        places = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert [out[k].labels for k in range(5)] == ["mit", "gpl-3", "cc-by-nc", "apache-2,mit", ""] and out[-1].labels == "gpl-3"
    (d,) = out[0].licenses
    assert d.rule == "grant:mit" and (d.start, d.stop) == (0, len("released under the mit license")) and len(licenses.rules()) >= 300


def strings_of(pattern):
    """All strings of a rule's pattern, which has only letters, sets, groups, alternatives and '?'."""
    from re import _constants as c
    from re import _parser

    def each(items):
        out = [""]
        for kind, value in items:
            if kind == c.LITERAL:
                more = [chr(value)]
            elif kind == c.IN:
                more = [chr(v) for _, v in value]
            elif kind == c.BRANCH:
                more = [x for part in value[1] for x in each(part)]
            elif kind == c.SUBPATTERN:
                more = each(value[3])
            elif kind in (c.ASSERT, c.ASSERT_NOT):
                more = [""]
            else:
                assert kind == c.MAX_REPEAT and value[:2] == (0, 1)
                more = ["", *each(value[2])]
            out = [a + b for a in out for b in more]
        return out

    return each(_parser.parse(pattern))


def test_license_gates_let_every_rule_pass():
    """Every name within every way: the gate, the needed words and the rule's own keywords are all there."""
    needs = re.compile(licenses.NEEDS)
    for kind, around, _, _, form, own in licenses.WAYS:
        ways = strings_of(around.replace("(?:{})", "@").replace("{}", "@"))
        for label, keyword, short, name in licenses.NAMES:
            names = strings_of(short if form == "id" else name)
            # Words beyond a way's shortest form only add to what is there.
            pairs = [(w, n) for w in ways for n in names[:1]] + [(w, n) for w in sorted(ways, key=len)[:4] for n in names]
            for w, n in pairs:
                t = w.replace("@", n)
                assert needs.search(t) and any(g in f" {t} " for g in licenses.GATE), (kind, label, t)
                assert any(k in t for k in keyword.split("|")) and any(k in t for k in own.split("|")), (kind, label, t)


def test_words_of_other_languages_are_no_licenses(spark):
    texts = [
        "Die Lizenz mit Einschränkungen gilt nicht.", "Eine License mit der Auflage, unter mit und see mit", "La licence est mise à jour; la licencia de conducir y la licenza di pesca", "see zlib and accept x11 terms, isc notice",
        "licence to kill, license plates, boost and ruby and elastic terms", "Mit Lizenz, mit Notice, mit terms", "El mit de la licencia común del artículo", "the software is used for good", "rights are reserved for all",
    ]
    out = sorted(licenses.scan(frame(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [r.labels for r in out] == [""] * len(texts) and all(r.score == 0 for r in out)
    good = ["License: MIT", "Licencia: MIT 2020", "The MIT License", "license is the MIT", "SPDX-License-Identifier: MIT", "licensed under MIT", "see the zlib license", "X11 License terms"]
    assert [r.labels for r in sorted(licenses.scan(frame(spark, good)).collect(), key=lambda r: r.doc_id)] == ["mit"] * 6 + ["zlib", "x11"]


def test_license_columns_that_clash_or_repeat(spark):
    docs = frame(spark, ["Released under the MIT License.", None, "Released under the MIT License."]).withColumns({c: F.lit(f"my {c}") for c in ("plain", "rules", "found", "keywords", "labels", "n_words")})
    out = licenses.scan(docs).orderBy("doc_id").collect()
    assert [(r.plain, r.rules, r.found, r.keywords, r.labels, r.n_words) for r in out] == [("my plain", "my rules", "my found", "my keywords", x, n) for x, n in (("mit", 5), ("", 0), ("mit", 5))]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_wording_is_found_without_names(spark):
    """Every written-out rule finds its own shortest form, through gates and keywords."""
    plain = lambda p: min(strings_of(p.replace("(?:[^ ]+ ){1,12}", "acme ").replace("(?:[^ ]+ ){0,4}", "")), key=len)
    texts = [plain(r[3]) for r in licenses.WORDING]
    assert all(r[2] in f" {x} " and any(g in x for g in licenses.WORDING_GATE) for r, x in zip(licenses.WORDING, texts))
    out = sorted(licenses.scan(frame(spark, [f"x {t.upper()}, y" for t in texts])).collect(), key=lambda r: r.doc_id)
    for rule, t, r in zip(licenses.WORDING, texts, out):
        assert rule[1] in r.labels.split(","), (rule[0], t, r.labels)


def test_rules_equal_brute_force(spark):
    """Labels and score by Python's re over every rule, with the suppression written as its definition."""
    rng = random.Random(15)
    parts = ["released under the mit license", "licensed under the apache license version 2 0", "gnu general public license version 3", "all rights reserved", "cc by nc sa 4 0 license", "see the bsd 3 clause license", "spdx license identifier mpl 2 0", "the quick brown fox", "und mit der", "creativecommons org licenses by nc sa 4 0", "subject to the", "gplv2", "dual licensed under the mit"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(60)] + ODD
    out = sorted(licenses.scan(frame(spark, texts)).collect(), key=lambda r: r.doc_id)
    for t, r in zip(texts, out):
        w = " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")))
        hits = [(m.start(), -m.end(), p, rule, label, c) for rule, label, _, _, pattern, p, c in licenses.rules() for m in re.finditer(pattern, w)] if len(w) < 10_000 else []
        kept = []
        for h in sorted(hits):
            if not any(k[2] <= h[2] and k[0] <= h[0] and k[1] <= h[1] for k in kept):
                kept.append(h)
        assert {k[4] for k in kept} | set(filter(None, r.base_labels.split(","))) == set(filter(None, r.labels.split(","))), t
        assert r.score == max([k[5] for k in kept] + [1.0 if r.n_base else 0.0])


def test_ordinary_forms_of_licenses(spark):
    cases = {
        "code: BSD-3-Clause": "bsd-3", "Apache-2.0": "apache-2", "GPLv3+": "gpl-3", "This is under the GNU Lesser General Public License v2.1 or later": "lgpl-2.1", "open source under the terms of gnu gpl v2 or later": "gpl-2",
        "dual licensed under MIT and Apache 2.0": "apache-2,mit", "licensed under either MIT or Apache License, Version 2.0": "apache-2,mit", "cc by nc nd 4.0": "cc-by-nc,cc-by-nc-nd", "data: CC BY-SA": "cc-by-sa", "AGPL-3.0-only": "agpl-3", "Apache 2.0 or MIT": "apache-2,mit",
        "mit and then some": "", "the apache helicopter": "", "either way or that": "", "a gnu at the zoo": "",
    }
    out = sorted(licenses.scan(frame(spark, list(cases))).collect(), key=lambda r: r.doc_id)
    assert {t: r.labels for t, r in zip(cases, out)} == cases


def test_licenses_with_glued_versions(spark):
    texts = ["Released under GPLv3.", "Distributed under the terms of the GPLv3", "This file is available under GPL3 terms", "Published under LGPLv3", "provided under the AGPL3", "see the gplv2"]
    out = sorted(licenses.scan(frame(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [r.labels for r in out] == ["gpl-3", "gpl-3", "gpl-3", "lgpl-3", "agpl-3", "gpl-2"] and all(r.score > 0 for r in out)


# --- 7 and 9


@pytest.fixture(scope="module")
def word_bpe():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, bpe.codec(path), Tokenizer.from_file(path)


def test_bpe_equals_the_library(spark, word_bpe):
    path, codec, library = word_bpe
    rng = random.Random(6)
    kinds = ["abcdefghij", "theanr", "  \t\n　", "'sdtrelv", ".,!-_", "0123²½", "éèßÀµ", "Σςб漢한", "é​\x1c", "😀👍🏽", "İK"]
    texts = ["".join(rng.choice(rng.choice(kinds)) if rng.random() < 0.95 else rng.choice(["<|endoftext|>", "'re", " the "]) for _ in range(rng.randint(0, 80))) for _ in range(400)] + [t for t in ODD if t]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        got = codec.encode(t)
        assert got == ids
        parts = [got[:2], got[2:3], got[3:]]
        d = bpe.Decoder(codec, joined=True)
        assert "".join(d.feed(p) for p in parts) + d.close() == library.decode(ids, skip_special_tokens=False)
    rows = bpe.decoded(bpe.encoded(frame(spark, ODD), path), path).collect()
    assert len(rows) == len(ODD) and rows[3].decoded == "same words in every one of these "


def test_bpe_equals_the_library_on_every_character(word_bpe):
    _, codec, library = word_bpe
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(every), 2048):
        text = " ".join(f"a{c}b!{c}! {c}" for c in every[k : k + 2048])
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(k)
    rng = random.Random(16)
    kinds = [(0x300, 0x36F), (0x898, 0x8E2), (0x1AB0, 0x1ACE), (0xAC00, 0xD7A3), (0x1100, 0x11FF), (0x10F46, 0x10F50), (0x11930, 0x11943), (0x1E00, 0x1FFF), (97, 122)]
    for _ in range(1500):
        text = "".join(chr(rng.randint(*rng.choice(kinds))) for _ in range(rng.randint(1, 20)))
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids, text.encode("unicode_escape")


def plain_merge(word, merges, end):
    """The definition: the first merge of the list that applies anywhere, at all its places from the left, again and again."""
    parts = [*word[:-1], word[-1] + end]
    while True:
        ranks = [merges.index(p) if p in merges else len(merges) for p in zip(parts, parts[1:])]
        if not ranks or min(ranks) == len(merges):
            return parts
        pair, out, k = merges[min(ranks)], [], 0
        while k < len(parts):
            joined = tuple(parts[k : k + 2]) == pair
            out.append("".join(pair) if joined else parts[k])
            k += 1 + joined
        parts = out


@pytest.mark.parametrize("end", ["", "$"])
def test_lookahead_is_sufficient_for_any_merge_list(end):
    """Random merge lists over few letters: equal to the definition, and tokens `lookahead` before a prefix's end stay."""
    rng = random.Random(17)
    for _ in range(60):
        letters = ["a", "b", "c"][: rng.choice([2, 3])]
        tokens, merges = [*letters, *([c + end for c in letters] if end else [])], []
        for _ in range(rng.randint(1, 14)):
            a, b = rng.choice([t for t in tokens if not end or not t.endswith(end)]), rng.choice(tokens)
            if (a, b) not in merges and a + b not in tokens:
                merges.append((a, b))
                tokens.append(a + b)
        m = bpe.Merges({t: k for k, t in enumerate(tokens)}, merges, end)
        t = bpe.Transducer(m)
        for _ in range(60):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 24)))
            whole = plain_merge(word, merges, end)
            assert [tokens[i] for i in t.whole(word)] == whole
            t.EVERY, out = 0, []
            for c in word:
                out += t.feed(c)
                assert len(t.last) <= m.lookahead + max(map(len, tokens)) + 3
            assert [tokens[i] for i in out + t.close()] == whole
            t.EVERY = 256
            # By the definition alone: what a prefix gives, up to the lookahead before its end, is in the whole.
            for n in range(1, len(word)):
                at = stable = 0
                for x in plain_merge(word[:n], merges, ""):
                    at += len(x)
                    stable += at <= n - m.lookahead
                assert plain_merge(word[:n], merges, "")[:stable] == whole[:stable]


def test_transducer_emits_early_and_forgets(word_bpe):
    _, codec, library = word_bpe
    rng = random.Random(7)
    t = bpe.Transducer(codec.words.transducer.m)
    for letters in ("aeinrst", "ea", "l"):
        word, out, most = "".join(rng.choice(letters) for _ in range(6000)), [], 0
        for k in range(0, len(word), 50):
            out += t.feed(word[k : k + 50])
            most = max(most, len(t.last))
        early = len(out)
        out += t.close()
        assert out == library.encode(word, add_special_tokens=False).ids and early > 0.8 * len(out) and most < t.m.lookahead + t.EVERY + 100 < 600
    assert list(codec.pieces(iter(["ab c", "d  ", "", "ef"]), size=4)) and [i for p in codec.pieces(iter(["ab c", "d  ", "", "ef"]), size=4) for i in p] == codec.encode("ab cd  ef")


def test_bpe_on_empty_tables_and_clashing_names(spark, word_bpe):
    path, codec, _ = word_bpe
    docs = frame(spark, ODD).withColumn("ids", F.lit("theirs")).withColumn("decoded", F.lit(1))
    out = bpe.encoded(docs, path)
    assert out.columns.count("ids") == 1 and [list(r.ids) for r in out.orderBy("doc_id").collect()] == [codec.encode(t) for t in ODD]
    assert {type(r.decoded) for r in bpe.decoded(out, path).collect()} == {str}
    assert bpe.encoded(docs.limit(0), path).count() == 0 and bpe.digests(docs.limit(0), path).count() == 0
    twice = bpe.digests(docs.unionByName(docs), path).groupBy("doc_id").agg(F.count_distinct("ids_sha256").alias("n"), F.count("*").alias("m")).collect()
    assert all((r.n, r.m) == (1, 2) for r in twice)


def test_workers_let_go_of_the_codec_when_another_stage_begins(spark, word_bpe):
    path, _, _ = word_bpe
    rows = spark.createDataFrame([(1, "some words")], "doc_id long, text string").coalesce(1)

    def kept(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bpe.codec.cache_info().currsize] * len(batch), pa.int32())], ["n"])

    bpe.encoded(rows, path).collect()
    assert rows.mapInArrow(kept, "n int").first().n == 1
    bpe.encoded(rows, path).collect()
    assert rows.mapInArrow(common.tidied(kept, "bpe"), "n int").first().n == 1
    assert rows.mapInArrow(common.tidied(kept), "n int").first().n == 0


def test_bytes_decode_across_tokens(word_bpe):
    _, codec, _ = word_bpe
    ids, d = codec.encode("漢字 é"), bpe.Decoder(codec)
    assert "".join(d.feed([i]) for i in ids) + d.close() == "漢字 é "


def test_bpe_digests(spark, word_bpe):
    import hashlib

    path, _, library = word_bpe
    for r in bpe.digests(frame(spark, ODD), path).collect():
        ids = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS, tiff.OLD_DEFLATE])
def test_tiff_round_trips(order, compression):
    rng = np.random.default_rng(compression)
    images = [rng.integers(0, rng.choice([2, 255]), (1 + 37 * k, 5 + 60 * k)).astype(np.uint8) for k in range(4)]
    for predictor in (1, 2):
        for tiled in (False, True):
            found = list(tiff.read_pages(tiff.write_pages(images, [(compression, predictor, tiled)] * 4, order)))
            assert len(found) == 4 and all((f.samples == i).all() for f, i in zip(found, images))


def test_packers_round_trip():
    rng = random.Random(8)
    for _ in range(150):
        data = bytes(rng.choice(rng.choice([b"a", b"ab", bytes(range(256))])) for _ in range(rng.choice([0, 1, 130, 9000])))
        assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data and tiff.lzw_unpack(tiff.lzw_pack(data), len(data)) == data
    # A stream made by hand: clear, 7, 7, the entry 258 that is just being made, end.
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 257))
    assert tiff.lzw_unpack(int(bits.ljust(40, "0"), 2).to_bytes(5, "big"), 3) == b"\7\7\7"


def test_tiff_pages_of_odd_files(spark):
    good = tiff.write_pages([np.zeros((3, 4), np.uint8)] * 2, [(tiff.DEFLATE, 2, False)] * 2)
    rows = [(0, good), (1, None), (2, b""), (3, b"garbage"), (4, good[:-40]), (0, good)]
    out = tiff.pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert sum(r.doc_id == 0 and r.error is None and bytes(r.samples) == b"\0" * 12 for r in out) == 4
    assert {r.doc_id for r in out if r.error} == {3, 4} and not any(r.doc_id in (1, 2) for r in out)
    for r in tiff.digests(frame(spark, ODD)).collect():
        raw = (ODD[r.doc_id] or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-16:]))


def test_tiff_digests_are_those_of_the_payload_and_the_file(spark):
    import hashlib

    texts = [*ODD, "plain text " * 900, "é漢" * 5000]
    docs = frame(spark, texts)
    out = tiff.digests(docs.unionByName(docs.limit(4))).collect()
    assert len(out) == len(texts) + 4 and tiff.digests(docs.limit(0)).count() == 0
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        n, media = tiff.text_to_tiff(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        rows = [padded[k : k + 192] for k in range(0, len(padded), 192)]
        steps = sum(abs(a - b) for row in rows for a, b in zip(row, row[1:]))
        shades = ",".join(str(sum(b >> 5 == k for b in padded)) for k in range(8))
        assert r.feature == f"pages={-(-len(rows) // 128)};rows={len(rows)};sum={sum(padded)};steps={steps};shades={shades}"


def by_hand(order, entries, strips):
    """A TIFF file written entry by entry, after the format's description: strips first, directory last."""
    import struct

    body, places = b"", []
    for s in strips:
        places.append(8 + len(body))
        body += s + b"\0" * (len(s) % 2)
    values = [*entries, (273, 4, places), (279, 4, [len(s) for s in strips])]
    at = 8 + len(body)
    extra, lines = b"", b""
    beyond = at + 2 + 12 * len(values) + 4
    for tag, kind, v in sorted(values):
        data = struct.pack(order + {3: "H", 4: "I"}[kind] * len(v), *v)
        if len(data) <= 4:
            lines += struct.pack(order + "HHI", tag, kind, len(v)) + data.ljust(4, b"\0")
        else:
            lines += struct.pack(order + "HHII", tag, kind, len(v), beyond + len(extra))
            extra += data
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at)
    return head + body + struct.pack(order + "H", len(values)) + lines + struct.pack(order + "I", 0) + extra


def test_foreign_tiff_files():
    """Files made here by hand: strips of unequal height, either byte order, known streams of each packing, 16 bits, three channels."""
    base = lambda w, h, c, rows, bits=(8,), n=1: [(256, 3, [w]), (257, 3, [h]), (258, 3, list(bits)), (259, 3, [c]), (262, 3, [1]), (277, 3, [n]), (278, 3, [rows])]
    want = np.arange(20, dtype=np.uint8).reshape(5, 4)
    for order in "<>":
        (p,) = tiff.read_pages(by_hand(order, base(4, 5, 1, 2), [want[:2].tobytes(), want[2:4].tobytes(), want[4:].tobytes()]))
        assert (p.samples.reshape(5, 4) == want).all()
        # The worked example of the PackBits description: 24 bytes from 15.
        packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
        (p,) = tiff.read_pages(by_hand(order, base(24, 1, 32773, 1), [packed]))
        assert p.samples.tobytes() == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
        # LZW: clear, 1, 2, the entry 258 (1 2), 258 again, end; differences undone by the predictor.
        bits = "".join(f"{c:09b}" for c in (256, 1, 2, 258, 258, 257))
        stream = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
        (p,) = tiff.read_pages(by_hand(order, [*base(6, 1, 5, 1), (317, 3, [2])], [stream]))
        assert p.samples.ravel().tolist() == [1, 3, 4, 6, 7, 9]
        (p,) = tiff.read_pages(by_hand(order, base(2, 1, 8, 1, (8, 8, 8), 3), [zlib.compress(bytes([9, 8, 7, 1, 2, 3]))]))
        assert p.samples.ravel().tolist() == [9, 8, 7, 1, 2, 3]
        deep = np.array([[258, 3], [65535, 0]], np.uint16)
        (p,) = tiff.read_pages(by_hand(order, base(2, 2, 1, 2, (16,)), [deep.astype(order + "u2").tobytes()]))
        assert p.samples.reshape(2, 2).tolist() == deep.tolist()


# --- 8


def test_budgets_go_to_siblings_first(spark):
    s = mixing.Settings((("d", lambda: F.col("lang")), ("s", lambda: F.col("source"))), {("a",): 1, ("b",): 1}, 1, budget_share=0.5, max_epochs=1)
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 500), ("b", "z", 90)], "d string, s string, tokens long")
    got = {r.s: r.grant for r in mixing.budgets(leaves, s).collect()}
    # 300 tokens: b can only give 90, so a gives 210; of these x gives its 10, y the rest.
    assert got == {"x": 10, "y": 200, "z": 90}


def test_budgets_pass_by_what_has_no_weight(spark):
    s = mixing.Settings((("d", lambda: F.col("lang")), ("s", lambda: F.col("source"))), {("a", "y"): 0, ("c",): 0}, 1, budget_share=0.5, max_epochs=1)
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 500), ("b", "z", 490), ("c", "w", 100)], "d string, s string, tokens long")
    got = {r.s: r.grant for r in mixing.budgets(leaves, s).collect()}
    # 550 tokens: of a only x can give, so z takes the rest as far as it has any.
    assert got == {"x": 10, "y": 0, "z": 490, "w": 0}


def test_mixing_equals_its_sql(spark):
    import duckdb

    rng = random.Random(9)
    rows = [(k, "t" * rng.randint(0, 400), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src6", "odd", None]), 0, "x", "y") for k in range(400)] + [(401, None, "en", "src0", 0, "x", "y")]
    docs = spark.createDataFrame(rows, DOCS)
    odd = {("books",): 0, ("web", "en"): 0, ("other",): -3, ("forums", "de", "src6"): 0}
    narrow = mixing.Settings(mixing.LEVELS, mixing.WEIGHTS, 10, 0.4, 2, bucket_digits=1, ordered_places=3)
    for s in (mixing.MIX, mixing.Settings(mixing.LEVELS, mixing.WEIGHTS, 10, 1.7, 3), mixing.Settings(mixing.LEVELS, mixing.WEIGHTS | odd, 1, 0.6, 2), narrow):
        got = sorted((r.doc_id, r.mix_epoch, r.mix_tokens) for r in mixing.mixed(docs, s).collect())
        c = duckdb.connect()
        documents = docs.toPandas()  # noqa: F841
        want = sorted((int(a), int(b), int(d)) for a, b, d in c.sql(f"SELECT doc_id, mix_epoch, mix_tokens FROM ({mixing.oracle_sql(s)})").fetchall())
        assert got == want and got
    assert mixing.mixed(docs.limit(0), mixing.MIX).count() == 0
    clash = docs.withColumns({c: F.lit(c) for c in ("mix__id", "mix__lang", "mix__:rest", "mix_epoch", "prefix", "tokens", "place", "before")})
    out = mixing.mixed(clash.unionByName(clash.limit(5)), mixing.MIX)
    assert out.columns.count("mix_epoch") == 1 and {(r["mix__id"], r["mix__:rest"], r["place"]) for r in out.collect()} == {("mix__id", "mix__:rest", "place")}


# --- the pipeline


def pipeline_rows():
    rows = [(k, t, "en", f"src{k % 4}", len(t)) for k, t, *_ in corpus()] + [(900 + k, near_texts()[k], "fr", "src9", 9) for k in range(20)]
    return rows + [(950, None, None, None, None), (951, "", "de", "src1", 0), (952, "same " * 9, "de", None, 1), (952, "same " * 9, "de", None, 1), (None, "no id at all here", "en", "src0", 1), (953, "long " * 20_000, "en", "src2", 1)]


def test_every_stage_of_the_pipeline_equals_a_plain_version(spark, tmp_path, word_bpe):
    import corpus_pipeline
    import duckdb

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(k, q, t) for k, _, q, t in corpus()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(pipeline_rows(), schema).withColumns({c: F.lit(f"my {c}") for c in ("score", "selected", "mix_epoch", "rep")})
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(docs.collect(), key=key)
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name == "toxicity":
            at, weight, bias = toxicity.fit(docs, labels)
            w = dict(zip(at.tolist(), weight.tolist()))
            score = [bias + sum(w.get(int(b), 0.0) for b in x) for x in toxicity.features([r.text for r in before], toxicity.Settings())]
            want = [r for r, x in zip(before, score) if x < 0]
        elif name == "quality":
            s = quality.Settings()
            ratio = quality.fit(docs, labels, s)
            weights = [sum(ratio[b] for b in quality.ngrams([r.text], s.bits)[1]) for r in before]
            keyed = {(r.doc_id, r.text): r.gumbel_key for r in quality.gumbel_keys(quality.weigh(docs, ratio, s), s.seed).collect()}
            k = sum(x >= -math.log(s.odds) for x in weights)
            least = sorted((keyed[r.doc_id, r.text] for r in before), reverse=True)[k - 1]
            want = [r for r in before if keyed[r.doc_id, r.text] >= least]
        elif name == "near duplicates":
            named = [r for r in before if r.doc_id is not None]
            root, seen = plain_classes([r.text for r in named]), set()
            want = [r for r in before if r.doc_id is None]
            for k, r in enumerate(named):
                if root[k] == k and r.doc_id not in seen:
                    want.append(r)
                    seen.add(r.doc_id)
        elif name == "mixing":
            documents = docs.toPandas()  # noqa: F841
            taken = duckdb.connect().sql(f"SELECT DISTINCT doc_id FROM ({mixing.oracle_sql(corpus_pipeline.MIX)})").fetchall()
            want = [r for r in before if (r.doc_id,) in taken]
        else:
            got = sorted((-1 if r.doc_id is None else r.doc_id, r.lang, r.source, r.n_tokens, list(r.ids)) for r in out.collect())
            ids = [word_bpe[2].encode(r.text or "", add_special_tokens=False).ids for r in before]
            assert got == sorted((-1 if r.doc_id is None else r.doc_id, r.lang, r.source, len(i), i) for r, i in zip(before, ids))
            break
        got = sorted(out.collect(), key=key)
        assert out.columns == docs.columns and got == sorted(want, key=key) and 0 < len(got) < len(before), name
        assert all(r.score == "my score" and r.selected == "my selected" and r.mix_epoch == "my mix_epoch" for r in got)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, t, "en", f"src{k % 4}", len(t)) for k, t, *_ in corpus()] + [(900 + k, near_texts()[k] or "", "fr", "src9", 9) for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, q, t) for k, _, q, t in corpus()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        after = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert 0 < after.count() <= docs.count()
        docs = after
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids)) and "ids" in docs.columns
