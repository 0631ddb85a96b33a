import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sortarium.functions import text as T

SAMPLE = "\n".join(["a.b@example.com", "SA0380000000608010167519", "300000000000003", "0512345678", "1042779318", "123456789"])
PATTERNS = [(r.name, p, r.placeholder) for r, p in zip(T.RULES, (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", r"(?i)\bSA\d{22}\b", r"\b3\d{14}\b", r"(?:\+?966|00966|0)5\d{8}\b", r"\b[12]\d{9}\b", r"\b\d{9,}\b"))]


def plain_masked(text):
    for _, pattern, placeholder in PATTERNS:
        text = re.sub(pattern, placeholder, text)
    return text


def plain_light(text):
    text = unicodedata.normalize("NFKC", text)
    for pattern, to in ((r"[​-‏‪-‮⁦-⁩﻿]", ""), (r"[ؐ-ًؚ-ٰٟۖ-ۭ]", ""), ("ـ+", ""), (r"[ \t ]+", " "), (r"\n{3,}", "\n\n")):
        text = re.sub(pattern, to, text)
    return "\n".join(x.strip() for x in text.split("\n")).strip()


def column(spark, texts, f):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r[1] for r in sorted(rows.select("k", f(F.col("text")).alias("out")).collect())]


def fuzzed(n, seed=3):
    rng = random.Random(seed)
    parts = ["SA", "sa", "3", "05", "+966", "00966", "1", "2", "٣", "123456789", "12345678", "ً", " ", "-", ".", "@", "a", "é", "ب", "_", "x@y.z", "\n", "0512345678", "300000000000003", "0380000000608010167519"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_masking_equals_the_definition(spark):
    texts = [*fuzzed(3000), SAMPLE, "", "12/03/1445 500 ريال"]
    assert column(spark, texts, T.masked) == [plain_masked(t) for t in texts]


def test_each_rule_hits_the_sample_once(spark):
    (found,) = column(spark, [SAMPLE], T.scan)
    assert found == {r.name: 1 for r in T.RULES}


def test_counts_are_of_progressively_masked_text(spark):
    def plain(text):
        out = {}
        for name, pattern, placeholder in PATTERNS:
            if n := len(re.findall(pattern, text)):
                out[name] = n
            text = re.sub(pattern, placeholder, text)
        return out

    texts = fuzzed(400, 5)
    assert column(spark, texts, T.scan) == [plain(t) for t in texts]


def test_masking_twice_changes_nothing(spark):
    once = column(spark, [SAMPLE], T.masked)
    assert column(spark, once, T.masked) == once


def test_null_stays_null(spark):
    assert column(spark, [None], T.masked) == [None] and column(spark, [None], T.scan) == [{}]


def test_summary(spark):
    assert column(spark, [SAMPLE, "nothing"], lambda c: T.summarize(T.scan(c))) == ["email=1, iban=1, long_number=1, national_id=1, phone=1, tax_number=1", "no identifiers found"]


def test_light_equals_the_definition(spark):
    rng = random.Random(1)
    parts = ["ﻻ", "ﷲ", "ـ", "ـــ", "َ", "‏", " ", "\t", " ", "\n", "\n\n\n", "a", "ب", "Ａ", "　", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(600)]
    assert column(spark, texts, T.light) == [plain_light(t) for t in texts]


def test_aggressive_folds_variants(spark):
    assert column(spark, ["إجازة", "اجازة", "٢٠٢٤ ABC!x"], T.aggressive) == ["اجازه", "اجازه", "2024 ABC x"]


@pytest.mark.parametrize("text, arabic", [("", False), ("123 !", False), ("hello", False), ("مرحبا", True), ("مabcd", True), ("مabcde", False)])
def test_looks_arabic(spark, text, arabic):
    assert column(spark, [text], T.looks_arabic) == [arabic]


def test_request_masks_before_it_cuts(spark):
    long = "x" * 15_995 + " 1042779318 " + "y" * 9_000
    (out,) = column(spark, [long], T.prepared)
    assert "1042779318" not in out and "104" not in out and "حُذف" in out
    assert column(spark, ["  \n ", None], T.prepared) == [T.EMPTY, T.EMPTY]


def test_envelope_names_the_origin(spark):
    digital, other = (column(spark, ["abc"], lambda c, s=s: T.envelope(c, F.lit(s), F.lit(2)))[0] for s in ("digital", "plain"))
    assert "نص رقمي" in digital and "ضوئيا" in other and digital.count("\n") == 4


def test_example_is_cut_and_masked(spark):
    (out,) = column(spark, ["a" * 195 + " 1042779318 " + "b" * 50], lambda c: T.example_text(c, 200))
    assert out.endswith(" …") and "1042" not in out


def test_noise_is_seeded_and_bounded(spark):
    text = "بحث عن سيارة " * 200
    a, b = (column(spark, [text], lambda c: T.ocr_noise(c, F.lit(9)))[0] for _ in range(2))
    assert a == b != text and abs(len(a) - len(text)) < 0.03 * len(text)


@pytest.mark.parametrize("reply", ['{"a": 1}', '```json\n{"a": 1}\n```', '```\n{"a": 1}\n```', 'Sure: {"a": 1} - done'])
def test_json_of_reply(spark, reply):
    assert T.json_of_reply(reply) == {"a": 1}
    assert column(spark, [reply], lambda c: T.json_column(c, "a int"))[0].a == 1


@given(st.text(max_size=30))
@settings(max_examples=50, deadline=None)
def test_json_of_reply_never_returns_anything_else(text):
    try:
        assert isinstance(T.json_of_reply(text), dict)
    except ValueError:
        pass


def test_file_name(spark):
    assert column(spark, ["a/b c.1"], T.file_name) == ["a_b_c.1"]
