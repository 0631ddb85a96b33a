"""Every query over the driver's tables by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sortarium import reporting, session
from sortarium.functions import text as T
from sortarium.operators import classify, evaluate, fewshot, labels, queue, threshold, tiebreak
from sortarium.plans import inputs
from sortarium.plans.inputs import SQL, TAXONOMY, table
from sortarium.sources import documents as io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def with_tables(sql: str) -> str:
    return f"WITH {SQL} {sql}" if sql.startswith("SELECT") else f"WITH {SQL}, {sql}"


# --- text ---------------------------------------------------------------------------------------

#: The masking patterns of functions.text where words are ASCII, as in the driver's tables.
PLAIN = (
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "[بريد]"),
    ("iban", r"(?i)\bSA\d{22}\b", "[آيبان]"),
    ("tax_number", r"\b3\d{14}\b", "[رقم ضريبي]"),
    ("phone", r"(?:\+?966|00966|0)5\d{8}\b", "[جوال]"),
    ("national_id", r"\b[12]\d{9}\b", "[رقم هوية]"),
    ("long_number", r"\b\d{9,}\b", "[رقم]"),
)


def plain_masked(column: str, rules=PLAIN) -> str:
    for _, pattern, placeholder in rules:
        column = f"regexp_replace({column}, '{pattern}', '{placeholder}', 'g')"
    return column


_COUNTS = ", ".join(f"CAST(sum(len(regexp_extract_all({plain_masked('text', PLAIN[:k])}, '{p}'))) AS BIGINT) AS {n}" for k, (n, p, _) in enumerate(PLAIN))


@query(f"SELECT lang, count(*) AS documents, {_COUNTS} FROM documents GROUP BY lang")
def redact_counts_by_lang(spark, sf_dir):
    """Identifiers of each kind that masking would replace, per language."""
    found = table(spark, sf_dir, "documents").select("lang", T.redaction(F.col("text"))["hits"].alias("hits"))
    return found.groupBy("lang").agg(F.count("*").alias("documents"), *[F.sum(F.col("hits")[k]).alias(rule.name) for k, rule in enumerate(T.RULES)])


@query(f"SELECT doc_id, md5({plain_masked('text')}) AS masked FROM documents")
def redact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.masked(F.col("text")).cast("binary")).alias("masked"))


@query(f"SELECT conv_id, turn, md5({plain_masked('text')}) AS masked FROM conversations")
def redact_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.masked(F.col("text")).cast("binary")).alias("masked"))


_FOUND = ", ".join(f"CASE WHEN n_{n} > 0 THEN '{n}=' || n_{n} END" for n in sorted(n for n, *_ in PLAIN))
_EACH = ", ".join(f"len(regexp_extract_all({plain_masked('text', PLAIN[:k])}, '{p}')) AS n_{n}" for k, (n, p, _) in enumerate(PLAIN))


@query(f"SELECT * FROM (SELECT doc_id, concat_ws(', ', {_FOUND}) AS found FROM (SELECT doc_id, {_EACH} FROM documents)) WHERE found <> ''")
def redact_summary(spark, sf_dir):
    """Documents with identifiers, and what was found in each, as one line."""
    found = table(spark, sf_dir, "documents").select("doc_id", T.scan(F.col("text")).alias("found")).where(F.size("found") > 0)
    return found.select("doc_id", T.summarize(F.col("found")).alias("found"))


_STRIPPED = r"regexp_replace(text, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')"
_READY = f"""CASE WHEN length(m) > 24000 THEN substr(m, 1, 16000) || chr(10) || chr(10) || '[... حُذف ' || (length(m) - 20000) || ' حرفاً من وسط الوثيقة ...]' || chr(10) || chr(10) || right(m, 4000) ELSE m END"""


@query(
    f"""SELECT doc_id, md5('مصدر النص: نص مستخرج ضوئياً (قد يحتوي أخطاء)' || chr(10) || 'عدد الصفحات: 1' || chr(10) || '--- بداية الوثيقة ---' || chr(10) ||
    CASE WHEN m = '' THEN '{T.EMPTY}' ELSE {_READY} END || chr(10) || '--- نهاية الوثيقة ---') AS envelope, length(m) > 24000 AS cut
    FROM (SELECT doc_id, {plain_masked(_STRIPPED)} AS m FROM documents)"""
)
def truncate_envelope(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    whole = T.envelope(F.col("text"), F.lit("plain"), F.lit(1))
    return docs.select("doc_id", F.md5(whole.cast("binary")).alias("envelope"), (F.length(T.masked(T.strip(F.col("text")))) > T.MAX_CHARS).alias("cut"))


_ARABIC = ("abcdefgh", "ابتثجحخد")


@query(
    f"""SELECT doc_id, n > 0 AND len(regexp_extract_all(t, '[\u0621-\u064a]')) >= CAST(0.2 AS DOUBLE) * n AS arabic
    FROM (SELECT *, len(regexp_extract_all(t, '\\p{{L}}')) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE translate(text, '{_ARABIC[0]}', '{_ARABIC[1]}') END AS t FROM documents))"""
)
def arabic_share(spark, sf_dir):
    """Two texts of three have some Latin letters replaced by Arabic ones, which puts their shares on both sides of the threshold."""
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.translate("text", *_ARABIC))
    return table(spark, sf_dir, "documents").select("doc_id", T.looks_arabic(text).alias("arabic"))


def sql_light(column: str) -> str:
    """light() in DuckDB, for texts that compatibility forms don't occur in."""
    out = f"nfc_normalize(coalesce({column}, ''))"
    for pattern, by in (("[\u200b-\u200f\u202a-\u202e\u2066-\u2069\ufeff]", "''"), ("[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed]", "''"), ("\u0640+", "''"), ("[ \t\u00a0]+", "' '"), ("\n{3,}", "chr(10) || chr(10)")):
        out = f"regexp_replace({out}, '{pattern}', {by}, 'g')"
    return sql_strip(f"array_to_string(list_transform(string_split({out}, chr(10)), lambda line: {sql_strip('line')}), chr(10))")


_BLANKS = "\\t\\n\\x0b\\x0c\\r\\x1c-\\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def sql_strip(column: str) -> str:
    return f"regexp_replace({column}, '^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g')"


def sql_aggressive(column: str) -> str:
    out = f"translate(translate({sql_light(column)}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), 'أإآٱىئیؤةک', 'اااايييوهك')"
    out = f"regexp_replace({out}, '[^ء-ي0-9a-zA-Z{_BLANKS}]', ' ', 'g')"
    return sql_strip(f"regexp_replace({out}, '[ \t\u00a0]+', ' ', 'g')")


@query(f"SELECT doc_id, md5({sql_light('text')}) AS light FROM documents")
def nfkc_light(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.light(F.col("text")).cast("binary")).alias("light"))


@query(f"SELECT doc_id, md5({sql_aggressive('text')}) AS aggressive FROM documents")
def aggressive_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.aggressive(F.col("text")).cast("binary")).alias("aggressive"))


@query(
    f"""SELECT doc_id, md5(CASE WHEN length(bare) > 700 THEN regexp_replace(substr(m, 1, 700), '[{_BLANKS}]+$', '') || ' …' ELSE m END) AS shown
    FROM (SELECT doc_id, bare, {plain_masked('bare')} AS m FROM (SELECT doc_id, {sql_strip('text')} AS bare FROM documents))"""
)
def example_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.example_text(F.col("text")).cast("binary")).alias("shown"))


@query("SELECT doc_id, CAST(quality AS VARCHAR) AS institution_id, CAST(toxic AS DOUBLE) / 4 AS confidence FROM labels")
def reply_json(spark, sf_dir):
    """The object in replies that are bare, fenced or wrapped in prose."""
    body = F.to_json(F.struct(F.col("quality").cast("string").alias("institution_id"), (F.col("toxic") / 4).alias("confidence")))
    reply = F.when(F.col("doc_id") % 3 == 0, body).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("The answer is "), body, F.lit(" as asked.")))
    found = T.json_column(reply, "institution_id string, confidence double")
    return table(spark, sf_dir, "labels").select("doc_id", found["institution_id"].alias("institution_id"), found["confidence"].alias("confidence"))


_CLEAN = f"c AS (SELECT item_id, {sql_aggressive('text')} AS t FROM benchmark), w AS (SELECT item_id, unnest(regexp_split_to_array(lower(t), '\\s+')) AS word FROM c)"
_GRAMS = """g AS (SELECT item_id, substr(' ' || word || ' ', CAST(i AS BIGINT), n) AS gram, count(*) AS tf FROM w, range(3, 6) s(n), LATERAL (SELECT unnest(range(1, length(word) + 4 - n)) AS i) WHERE word <> '' GROUP BY ALL),
  d AS (SELECT gram, count(*) AS df, sum(tf) AS cf FROM g GROUP BY gram ORDER BY cf DESC, gram LIMIT 50000),
  x AS (SELECT item_id, gram, tf * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + df)) + 1) AS weight FROM g JOIN d USING (gram))"""


@query(f"WITH {_CLEAN}, {_GRAMS} SELECT item_id, gram, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY item_id)), 9) AS weight FROM x")
def char_tfidf(spark, sf_dir):
    """Every weight of the vectors that the queue's similarity uses, for the benchmark's texts."""
    from sortarium.operators import vectors

    rows = table(spark, sf_dir, "benchmark")
    known = vectors.char_vocabulary(rows, "text")
    made = rows.select("item_id", vectors.sparse_column(spark, F.col("text"), known, vectors.char_grams).alias("v"))
    parts = made.select("item_id", F.explode(F.arrays_zip("v.at", "v.w")).alias("p")).select("item_id", F.col("p.at").alias("at"), F.round("p.w", 9).alias("weight"))
    names = spark.createDataFrame(list(enumerate(known.blocks[0])), "at int, gram string")
    return parts.join(F.broadcast(names), "at").select("item_id", "gram", "weight")


@query(
    f"""WITH {_CLEAN}, l AS (SELECT item_id, regexp_extract_all(lower(t), '\\w\\w+') AS words FROM c)
    SELECT item_id, gram, count(*) AS n FROM (SELECT item_id, unnest(words) AS gram FROM l UNION ALL SELECT item_id, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM l) GROUP BY ALL"""
)
def word_grams(spark, sf_dir):
    from sortarium.operators import vectors

    grams = vectors.gram_column(F.col("text"), vectors.baseline_grams, 1)
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(grams).alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS file_name FROM pages")
def file_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.file_name(F.col("url")).alias("file_name"))


@query(
    with_tables(
        f"""c AS (SELECT doc_id, lang AS label, lower({sql_aggressive('text')}) AS t FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
        w AS (SELECT label, doc_id, unnest(regexp_extract_all(t, '\\w\\w+')) AS gram FROM c), k AS (SELECT label, gram, count(*) AS n, count(DISTINCT doc_id) AS texts FROM w GROUP BY ALL),
        s AS (SELECT label, CAST(sum(n) AS DOUBLE) AS size FROM k GROUP BY label), e AS (SELECT gram, CAST(sum(n) AS DOUBLE) * 500 / (SELECT sum(n) FROM k) AS alpha FROM k GROUP BY gram),
        m AS (SELECT p.a, p.b, e.gram, alpha, sa.size AS size_a, sb.size AS size_b, coalesce(ka.n, 0) AS n_a, coalesce(kb.n, 0) AS n_b, coalesce(ka.texts, 0) AS texts_a, coalesce(kb.texts, 0) AS texts_b
          FROM pairs p JOIN s sa ON sa.label = p.a JOIN s sb ON sb.label = p.b CROSS JOIN e LEFT JOIN k ka ON ka.label = p.a AND ka.gram = e.gram LEFT JOIN k kb ON kb.label = p.b AND kb.gram = e.gram WHERE ka.n IS NOT NULL OR kb.n IS NOT NULL),
        z AS (SELECT *, (ln((n_a + alpha) / (size_a + 500 - n_a - alpha)) - ln((n_b + alpha) / (size_b + 500 - n_b - alpha))) / sqrt(1 / (n_a + alpha) + 1 / (n_b + alpha)) AS z FROM m),
        t AS (SELECT a, b, CASE WHEN z > 0 THEN a ELSE b END AS label, gram, abs(z) AS z FROM z WHERE (z > 0 AND texts_a >= 2) OR (z < 0 AND texts_b >= 2))
        SELECT a, b, label, CAST(row_number() OVER (PARTITION BY a, b, label ORDER BY round(z, 9) DESC, gram) AS INTEGER) AS place, gram, round(z, 6) AS z FROM t QUALIFY place <= 6"""
    )
)
def pair_distinctions(spark, sf_dir):
    """The words that tell two confused languages apart, over all documents."""
    from sortarium.operators import distinctions

    gold = table(spark, sf_dir, "documents").select(F.col("lang").alias("label"), "text")
    return distinctions.distinctions(gold, TAXONOMY.pairs(spark)).withColumn("z", F.round("z", 6))


# --- evaluation -----------------------------------------------------------------------------------


def joined(spark, sf_dir) -> DataFrame:
    """Predictions beside the truth of labelled documents, by the operators' own join."""
    truth = evaluate.truth_of(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")
    return evaluate.scored(truth, inputs.predictions(spark, sf_dir))


@query(
    with_tables(
        """SELECT count(*) AS total, CAST(sum(hit) AS BIGINT) AS correct, sum(hit) / count(*) AS accuracy, count(*) FILTER (NOT needs_review) AS auto_routed,
        coalesce(sum(hit) FILTER (NOT needs_review) / count(*) FILTER (NOT needs_review), 0) AS auto_accuracy, count(*) FILTER (needs_review) AS held,
        CAST(coalesce(sum(hit) FILTER (needs_review), 0) AS BIGINT) AS held_correct, round(coalesce(sum(pm) FILTER (hit = 1) / 1000 / count(*) FILTER (hit = 1), 0), 9) AS mean_confidence_correct,
        round(coalesce(sum(pm) FILTER (hit = 0) / 1000 / count(*) FILTER (hit = 0), 0), 9) AS mean_confidence_wrong FROM scored"""
    )
)
def eval_summary(spark, sf_dir):
    return evaluate.summary(joined(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("mean_confidence_correct", "mean_confidence_wrong")})


_CLASS = """x AS (SELECT institution_id, ord, (SELECT count(*) FROM scored WHERE gold = institution_id AND hit = 1) AS tp, (SELECT count(*) FROM scored WHERE pred = institution_id AND hit = 0) AS fp,
  (SELECT count(*) FROM scored WHERE gold = institution_id AND hit = 0) AS fn, (SELECT count(*) FROM scored WHERE gold = institution_id) AS support FROM tax),
y AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM x)"""


@query(with_tables(_CLASS + " SELECT institution_id, ord, tp, fp, fn, support, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM y"))
def eval_per_class(spark, sf_dir):
    return evaluate.per_class(joined(spark, sf_dir), TAXONOMY.dimension(spark))


@query(with_tables(_CLASS + " SELECT round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 9) AS macro_f1 FROM y WHERE support > 0"))
def eval_macro_f1(spark, sf_dir):
    return evaluate.macro_f1(evaluate.per_class(joined(spark, sf_dir), TAXONOMY.dimension(spark))).select(F.round("macro_f1", 9).alias("macro_f1"))


_CELLS = "x AS (SELECT gold, predicted, CAST(sum(n) AS BIGINT) AS n FROM (SELECT gold, pred AS predicted, count(*) AS n FROM scored GROUP BY ALL UNION ALL SELECT a, b, 0 FROM pairs UNION ALL SELECT b, a, 0 FROM pairs) GROUP BY ALL)"


@query(with_tables(_CELLS + " SELECT * FROM x"))
def eval_confusion(spark, sf_dir):
    return evaluate.confusion(joined(spark, sf_dir), TAXONOMY.pairs(spark))


@query(with_tables(_CELLS + " SELECT a || ' <-> ' || b AS pair, CAST(sum(n) AS BIGINT) AS errors FROM pairs JOIN x ON (gold = a AND predicted = b) OR (gold = b AND predicted = a) GROUP BY ALL"))
def eval_pair_errors(spark, sf_dir):
    pairs = TAXONOMY.pairs(spark)
    return evaluate.pair_errors(evaluate.confusion(joined(spark, sf_dir), pairs), pairs)


@query(with_tables("SELECT gold, pred AS predicted, count(*) AS n FROM scored WHERE hit = 0 GROUP BY ALL"))
def eval_misroutes(spark, sf_dir):
    return evaluate.misroutes(joined(spark, sf_dir))


@query(with_tables("SELECT (SELECT count(*) FROM labels) AS labelled, (SELECT count(*) FROM scored) AS predicted, (SELECT count(*) FROM scored JOIN labels USING (doc_id)) AS scored"))
def eval_mismatch(spark, sf_dir):
    truth = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("gold"))
    return evaluate.mismatch(truth, inputs.predictions(spark, sf_dir))


@query(with_tables("SELECT gold, count(*) AS n, count(*) FILTER (pm % 2 = 0) AS n_hard, sum(hit) / count(*) AS accuracy, sum(hit) FILTER (pm % 2 = 0) / count(*) FILTER (pm % 2 = 0) AS hard_accuracy, CAST(0 AS BIGINT) AS errors FROM scored GROUP BY gold").replace("SELECT gold, count", "SELECT gold AS tag, count"))
def compare_runs(spark, sf_dir):
    rows = joined(spark, sf_dir).select(F.col("gold").alias("tag"), "gold", F.col("institution_id").alias("pred"), (F.col("pm") % 2 == 0).alias("hard"), F.lit(None).cast("string").alias("error"))
    return evaluate.compare_runs(rows)


@query(with_tables("SELECT 'synthetic' AS backend FROM scored LIMIT 1"))
def eval_backend(spark, sf_dir):
    return evaluate.first_backend(joined(spark, sf_dir), "doc_id")


# --- thresholds -----------------------------------------------------------------------------------

_SWEEP = """x AS (SELECT threshold, count(*) FILTER (confidence >= threshold) AS auto_routed, CAST(coalesce(sum(hit) FILTER (confidence >= threshold), 0) AS BIGINT) AS auto_correct, count(*) AS total, CAST(sum(hit) AS BIGINT) AS right_total FROM grid CROSS JOIN {rows} GROUP BY threshold),
y AS (SELECT threshold, auto_routed, auto_routed / total AS coverage, auto_correct, CASE WHEN auto_routed > 0 THEN auto_correct / auto_routed ELSE 0.0 END AS auto_accuracy, auto_routed - auto_correct AS misrouted, total - auto_routed AS held, right_total - auto_correct AS held_correct,
  CAST((auto_routed - auto_correct) * 20 + (total - auto_routed) AS DOUBLE) AS expected_cost, (auto_correct + total - auto_routed) / total AS resolved_accuracy FROM x)"""
_POINTS = _SWEEP.format(rows="scored")


@query(with_tables(_POINTS + " SELECT * FROM y"))
def threshold_sweep(spark, sf_dir):
    return threshold.sweep(inputs.scored(spark, sf_dir))


@query(with_tables(_POINTS + " SELECT * FROM y WHERE auto_routed > 0 AND auto_accuracy >= CAST(0.95 AS DOUBLE) ORDER BY coverage DESC, threshold LIMIT 1"))
def recommend_target(spark, sf_dir):
    return threshold.recommend_for_target(threshold.sweep(inputs.scored(spark, sf_dir)), 0.95)


@query(with_tables(_POINTS + " SELECT * FROM y WHERE auto_routed > 0 AND auto_accuracy >= 1.5 LIMIT 1"))
def recommend_unreachable(spark, sf_dir):
    return threshold.recommend_for_target(threshold.sweep(inputs.scored(spark, sf_dir)), 1.5)


@query(with_tables(_POINTS + " SELECT * FROM y ORDER BY expected_cost, threshold LIMIT 1"))
def recommend_cost(spark, sf_dir):
    return threshold.recommend_min_cost(threshold.sweep(inputs.scored(spark, sf_dir)))


_BINS = """x AS (SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, count(*) AS n, sum(pm) AS pms, sum(hit) AS hits FROM scored GROUP BY 1),
y AS (SELECT bin, bin / 10 AS low, (bin + 1) / 10 AS high, n, round(pms / 1000 / n, 9) AS mean_confidence, hits / n AS accuracy, round(pms / 1000 / n - hits / n, 9) AS gap FROM x)"""


@query(with_tables(_BINS + " SELECT * FROM y"))
def calibration_bins(spark, sf_dir):
    out = threshold.calibration_bins(inputs.scored(spark, sf_dir))
    return out.withColumns({"mean_confidence": F.round("mean_confidence", 9), "gap": F.round("gap", 9)})


@query(
    with_tables(
        _BINS
        + """ SELECT round(e, 6) AS ece, round(m, 6) AS mean_confidence, round(a, 6) AS accuracy, CASE WHEN e < 0.05 THEN 'well calibrated' WHEN m - a > 0.05 THEN 'overconfident' WHEN m - a < -0.05 THEN 'underconfident' ELSE 'poorly calibrated (non-monotonic)' END AS verdict
        FROM (SELECT sum(n * abs(pms / 1000 / n - hits / n)) / sum(n) AS e, sum(pms) / 1000 / sum(n) AS m, sum(hits) / sum(n) AS a FROM x)"""
    )
)
def calibration_summary(spark, sf_dir):
    out = threshold.calibration(inputs.scored(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in ("ece", "mean_confidence", "accuracy")], "verdict")


@query(
    with_tables(
        """x AS (SELECT institution_id, threshold, count(pred) AS support, count(*) FILTER (confidence >= threshold) AS auto, coalesce(sum(hit) FILTER (confidence >= threshold), 0) AS good FROM tax CROSS JOIN grid LEFT JOIN scored ON pred = institution_id GROUP BY ALL),
        y AS (SELECT *, auto / support AS coverage, good / auto AS accuracy FROM x WHERE auto > 0 AND good / auto >= CAST(0.95 AS DOUBLE) QUALIFY row_number() OVER (PARTITION BY institution_id ORDER BY auto / support DESC, threshold) = 1),
        s AS (SELECT institution_id, ord, count(pred) AS support FROM tax LEFT JOIN scored ON pred = institution_id GROUP BY ALL)
        SELECT s.institution_id, ord, threshold, coalesce(coverage, 0) AS coverage, coalesce(accuracy, 0) AS auto_accuracy, s.support, s.support < 10 AS thin FROM s LEFT JOIN y USING (institution_id)"""
    )
)
def per_class_thresholds(spark, sf_dir):
    return threshold.per_class_thresholds(inputs.scored(spark, sf_dir), TAXONOMY.dimension(spark))


_ORDER = "doc_id * 104729 % 1000003"


@query(
    with_tables(
        f"""ranked AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}, doc_id) AS k, count(*) OVER () AS n FROM scored),
        train AS (SELECT * FROM ranked WHERE k <= CAST(trunc(n * (1 - CAST(0.4 AS DOUBLE))) AS BIGINT)), test AS (SELECT * FROM ranked WHERE k > CAST(trunc(n * (1 - CAST(0.4 AS DOUBLE))) AS BIGINT)),
        {_SWEEP.format(rows="train")},
        c AS (SELECT * FROM y WHERE auto_routed > 0 AND auto_accuracy >= CAST(0.95 AS DOUBLE) ORDER BY coverage DESC, threshold LIMIT 1),
        z AS (SELECT threshold, auto_accuracy AS train_accuracy, coverage AS train_coverage, count(*) AS n_test, count(*) FILTER (confidence >= threshold) AS auto, coalesce(sum(hit) FILTER (confidence >= threshold), 0) AS good FROM c CROSS JOIN test GROUP BY ALL)
        SELECT threshold, train_accuracy, train_coverage, CASE WHEN auto > 0 THEN good / auto ELSE 0.0 END AS test_accuracy, auto / n_test AS test_coverage, n_test, train_accuracy - CASE WHEN auto > 0 THEN good / auto ELSE 0.0 END AS optimism FROM z"""
    )
)
def split_validation(spark, sf_dir):
    rows = inputs.scored(spark, sf_dir)
    parts = threshold.split(rows.select("doc_id"), order=F.expr(_ORDER))
    return threshold.split_validate(rows, parts)


# --- label store ----------------------------------------------------------------------------------


@query(with_tables("SELECT doc_id, label, status, lane, model_label, seconds_spent, reviewer FROM now"))
def label_current(spark, sf_dir):
    return labels.current(inputs.label_log(spark, sf_dir)).drop("seq")


@query(with_tables("SELECT (SELECT count(*) FROM log) AS total_records, count(*) AS documents, count(*) FILTER (status = 'labeled') AS labeled, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'unclear') AS unclear FROM now"))
def label_stats(spark, sf_dir):
    return labels.stats(inputs.label_log(spark, sf_dir))


@query(
    with_tables(
        """x AS (SELECT lane, count(*) AS n, count(*) FILTER (label = model_label) AS agreed FROM now WHERE status = 'labeled' AND label <> '' AND model_label IS NOT NULL GROUP BY lane),
        y AS (SELECT *, agreed / n AS p, 1.96::DOUBLE * 1.96::DOUBLE AS zz FROM x)
        SELECT lane, n, agreed, p AS agreement, round(greatest(0, (p + zz / (2 * n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)), 9) AS low, round(least(1, (p + zz / (2 * n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)), 9) AS high FROM y"""
    )
)
def wilson_by_lane(spark, sf_dir):
    return labels.lanes(labels.current(inputs.label_log(spark, sf_dir))).withColumns({"low": F.round("low", 9), "high": F.round("high", 9)})


@query(ORACLE_SQL["wilson_by_lane"])
def label_stream(spark, sf_dir):
    """Agreement by lane from the events read as a stream: changes of keyed state, summed."""
    from sortarium.streaming import labels as stream

    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern may name a file, a stream's folder may not
    # the order of the log as one number: microseconds, and within one of them the id
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2020-01-01 00:00:00', seq.ts)")
    records = inputs.label_log(spark, sf_dir, raw).withColumn("seq", at * F.lit(1 << 14) + F.pmod(F.col("seq.event_id"), F.lit(1 << 14)))
    root = session.scratch_folder(spark)
    stream.run(records, f"{root}/changes", f"{root}/checkpoint").awaitTermination()
    lanes = stream.lanes(spark.read.schema(stream.CHANGE).parquet(f"{root}/changes")).collect()
    session.removed(spark, root)
    rows = [(r.lane, r.n, r.agreed, r.agreement, round(r.low, 9), round(r.high, 9)) for r in lanes]
    return spark.createDataFrame(rows, "lane string, n long, agreed long, agreement double, low double, high double")


@query(with_tables("SELECT list_sort(list(seconds_spent))[count(*) // 2 + 1] AS upper_median FROM now WHERE seconds_spent IS NOT NULL AND seconds_spent <> 0"))
def upper_median(spark, sf_dir):
    return labels.upper_median(labels.current(inputs.label_log(spark, sf_dir)), "seconds_spent")


@query(with_tables("SELECT institution_id, ord, count(label) AS have, greatest(0, 25 - count(label)) AS need FROM tax LEFT JOIN (SELECT label FROM now WHERE status = 'labeled' AND label <> '') ON label = institution_id GROUP BY ALL"))
def label_coverage(spark, sf_dir):
    return labels.coverage(labels.current(inputs.label_log(spark, sf_dir)), TAXONOMY.dimension(spark))


@query(with_tables("SELECT reviewer, count(*) AS n FROM now GROUP BY reviewer"))
def label_reviewers(spark, sf_dir):
    return labels.reviewers(labels.current(inputs.label_log(spark, sf_dir)))


@query(with_tables("SELECT d.doc_id, label AS true_label, source FROM documents d JOIN now n ON n.doc_id = d.doc_id AND status = 'labeled' AND label <> ''"))
def gold_export(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit("").alias("true_label"))
    return labels.exported(docs, labels.current(inputs.label_log(spark, sf_dir)))


@query(with_tables("SELECT doc_id FROM now WHERE status = 'labeled' AND label <> '' AND doc_id NOT IN (SELECT doc_id FROM labels)"))
def missing_gold(spark, sf_dir):
    return labels.missing(table(spark, sf_dir, "labels"), labels.current(inputs.label_log(spark, sf_dir)))


# --- queue and examples ---------------------------------------------------------------------------


@query(
    with_tables(
        """SELECT doc_id, round(1 - confidence + CAST(0.8 AS DOUBLE) * greatest(0, 1 - (confidence - alt_confidence)) + CASE WHEN EXISTS (SELECT 1 FROM pairs WHERE (a = pred AND b = alt) OR (a = alt AND b = pred)) THEN CAST(0.6 AS DOUBLE) ELSE 0 END
          + CASE WHEN pm % 3 = 0 AND hit = 0 THEN CAST(1.2 AS DOUBLE) ELSE 0 END, 6) AS score FROM scored"""
    )
)
def priority_scores(spark, sf_dir):
    """A second opinion that is right wherever pm is divisible by 3, and agrees elsewhere."""
    truth = inputs.truth(spark, sf_dir)
    rows = inputs.predictions(spark, sf_dir).join(truth, "doc_id").withColumn("baseline_label", F.when(F.col("pm") % 3 == 0, F.col("gold")).otherwise(F.col("institution_id")))
    return queue.priority(rows, TAXONOMY.pairs(spark)).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id FROM documents ORDER BY doc_id * 7919 % 1000003, doc_id LIMIT 10")
def random_lane(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return queue.random_lane(docs, queue.lane_size(50, 0.2, docs.count()), order=F.expr("doc_id * 7919 % 1000003"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events)")
def queue_anti(spark, sf_dir):
    return queue.pool(table(spark, sf_dir, "documents").select("doc_id"), labels.decided(labels.current(inputs.label_log(spark, sf_dir))))


@query(
    """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label, (vec_id * 7919 + 17) % 1001 / 1000.0::DOUBLE * 3 AS score FROM embeddings),
    r AS (SELECT 0 AS step, vec_id, e, label, score, NULL::DOUBLE AS near, 0 AS pick FROM v
      UNION ALL SELECT step + 1, vec_id, e, label, score, greatest(coalesce(near, -1), list_cosine_similarity(e, first_e)), CASE WHEN vec_id = first_id THEN step + 1 ELSE pick END
      FROM (SELECT *, first_value(vec_id) OVER best AS first_id, first_value(e) OVER best AS first_e
        FROM (SELECT *, pick = 0 AND count(*) FILTER (pick > 0) OVER (PARTITION BY label) < 6 AS free FROM r WHERE step < 20)
        WINDOW best AS (ORDER BY free DESC, score - CASE WHEN step = 0 THEN 0 ELSE 1.5::DOUBLE * near END DESC, score DESC, vec_id)))
    SELECT vec_id AS doc_id, CAST(pick AS INTEGER) AS pick FROM r WHERE step = 20 AND pick > 0"""
)
def mmr_queue(spark, sf_dir):
    """The 20 vectors of a batch by score less similarity to those chosen; the score follows from the id."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("string").alias("label"), ((F.col("vec_id") * 7919 + 17) % 1001 / 1000.0 * 3).alias("score"))
    return queue.diverse(rows, 20, cap=6, vector="embedding", text=None)


_QUEUE = """free AS (SELECT s.* FROM scored s WHERE doc_id NOT IN (SELECT doc_id FROM now)),
  p AS (SELECT *, 1 - confidence + CAST(0.8 AS DOUBLE) * greatest(0, 1 - (confidence - alt_confidence)) + CASE WHEN EXISTS (SELECT 1 FROM pairs WHERE (a = pred AND b = alt) OR (a = alt AND b = pred)) THEN CAST(0.6 AS DOUBLE) ELSE 0 END AS score FROM free),
  lucky AS (SELECT *, 'random' AS lane FROM p ORDER BY doc_id * 7919 % 1000003, doc_id LIMIT 10),
  picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY score DESC, doc_id) AS k FROM p WHERE doc_id NOT IN (SELECT doc_id FROM lucky)) WHERE k <= 15 ORDER BY score DESC, doc_id LIMIT 40),
  both_lanes AS (SELECT doc_id, lane, 0.0::DOUBLE AS score, pred, alt, confidence FROM lucky UNION ALL SELECT doc_id, 'priority', score, pred, alt, confidence FROM picked),
  items AS (SELECT *, CAST(row_number() OVER (ORDER BY doc_id * 7919 % 1000003, doc_id) AS INTEGER) AS position FROM both_lanes)"""


def _plain_queue(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("path"), F.lit("plain").alias("source"))
    done = labels.decided(labels.current(inputs.label_log(spark, sf_dir)))
    return queue.build_queue(docs, inputs.predictions(spark, sf_dir), None, done, TAXONOMY.pairs(spark), cap=15, w=queue.Weights(redundancy_penalty=0.0), order=F.expr("doc_id * 7919 % 1000003"))


@query(with_tables(_QUEUE + " SELECT doc_id, lane, round(score, 3) AS score, pred AS model_label, confidence AS model_confidence, alt AS alternative, position FROM items"))
def queue_lanes(spark, sf_dir):
    """Both lanes in their order, with a given order in place of hashes and no penalty for similarity."""
    return _plain_queue(spark, sf_dir).select("doc_id", "lane", F.round("score", 3).alias("score"), "model_label", "model_confidence", F.col("alternatives")[0].alias("alternative"), "position")


@query(with_tables(_QUEUE + " SELECT doc_id, lane, CASE WHEN lane <> 'random' THEN round(score, 3) ELSE 0 END AS score, CASE WHEN lane <> 'random' THEN pred END AS model_label, CASE WHEN lane <> 'random' THEN confidence END AS model_confidence, CASE WHEN lane <> 'random' THEN alt END AS alternative FROM items"))
def queue_blind(spark, sf_dir):
    """What a reviewer may see of the same queue."""
    shown = queue.blind(_plain_queue(spark, sf_dir))
    return shown.select("doc_id", "lane", F.round("score", 3).alias("score"), "model_label", "model_confidence", F.get("alternatives", F.lit(0)).alias("alternative"))


def sql_two_places(x: str) -> str:
    """%.2f of a double, half up by its shortest digits."""
    return f"CAST(CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 20)), 2) AS DECIMAL(10, 2)) AS VARCHAR)"


_MARGIN = "(confidence - alt_confidence)"
_IS_PAIR = "EXISTS (SELECT 1 FROM pairs WHERE (a = pred AND b = alt) OR (a = alt AND b = pred))"
_GRAMS_OF_REST = _GRAMS.replace("item_id", "doc_id").replace("FROM benchmark", "FROM rest").replace("range(3, 6) s(n)", "range(3, 6) sizes(n)")


@query(
    "WITH RECURSIVE "
    + SQL
    + f""", free AS (SELECT s.*, 1 - confidence + CAST(0.8 AS DOUBLE) * greatest(0, 1 - {_MARGIN}) + CASE WHEN {_IS_PAIR} THEN CAST(0.6 AS DOUBLE) ELSE 0 END AS score,
    list_filter([CASE WHEN confidence < CAST(0.6 AS DOUBLE) THEN 'ثقة منخفضة (' || {sql_two_places("confidence")} || ')' END, CASE WHEN {_MARGIN} < CAST(0.15 AS DOUBLE) THEN 'فارق ضئيل عن البديل (' || {sql_two_places(_MARGIN)} || ')' END,
      CASE WHEN {_IS_PAIR} THEN 'زوج خلط معروف' END], lambda r: r IS NOT NULL) AS reasons FROM scored s WHERE doc_id NOT IN (SELECT doc_id FROM now)),
  lucky AS (SELECT * FROM free ORDER BY doc_id * 7919 % 1000003, doc_id LIMIT 10),
  rest AS MATERIALIZED (SELECT free.*, text FROM free JOIN documents USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM lucky)),
  c AS (SELECT doc_id, {sql_aggressive('text')} AS t FROM rest), w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(t), '\\s+')) AS word FROM c), {_GRAMS_OF_REST},
  vec AS MATERIALIZED (SELECT doc_id, gram, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS weight FROM x),
  r AS (SELECT 0 AS step, doc_id, pred AS label, score, 0.0::DOUBLE AS near, 0 AS pick FROM rest
    UNION ALL (WITH f AS (SELECT *, first_value(doc_id) OVER (ORDER BY open DESC, score - 1.5::DOUBLE * near DESC, score DESC, doc_id) AS first
        FROM (SELECT *, pick = 0 AND count(*) FILTER (pick > 0) OVER (PARTITION BY label) < 15 AS open FROM r WHERE step < 40)),
      n AS (SELECT b.doc_id, sum(a.weight * b.weight) AS sim FROM (SELECT any_value(first) AS first FROM f) JOIN vec a ON a.doc_id = first JOIN vec b USING (gram) GROUP BY ALL)
      SELECT step + 1, doc_id, label, score, greatest(near, coalesce(sim, 0)), CASE WHEN doc_id = first THEN step + 1 ELSE pick END FROM f LEFT JOIN n USING (doc_id))),
  items AS (SELECT doc_id, 'random' AS lane, 0.0::DOUBLE AS score, ['{queue.RANDOM_REASON}'] AS reasons, pred, alt, confidence FROM lucky
    UNION ALL SELECT doc_id, 'priority', round(rest.score, 4), CASE WHEN len(reasons) = 0 AND pick > 1 THEN ['{queue.DIVERSITY_REASON}'] ELSE reasons END, pred, alt, confidence FROM rest JOIN r USING (doc_id) WHERE step = 40 AND pick > 0)
  SELECT doc_id, lane, score, reasons, pred AS model_label, confidence AS model_confidence, 'synthetic' AS model_backend, '' AS model_rationale_ar, [alt] AS alternatives, NULL AS baseline_label, NULL AS path, 'plain' AS source,
    CAST(row_number() OVER (ORDER BY doc_id * 7919 % 1000003, doc_id) AS INTEGER) AS position FROM items"""
)
def build_queue(spark, sf_dir):
    """The batch of 50 documents to review, both lanes, diverse by their grams, in a given order in place of hashes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("path"), F.lit("plain").alias("source"))
    done = labels.decided(labels.current(inputs.label_log(spark, sf_dir)))
    return queue.build_queue(docs, inputs.predictions(spark, sf_dir), None, done, TAXONOMY.pairs(spark), cap=15, order=F.expr("doc_id * 7919 % 1000003")).drop("text")


@query(
    with_tables(
        """x AS (SELECT n.doc_id, n.label, coalesce(model_label, n.label) = n.label AS agrees, model_label, text, row_number() OVER (PARTITION BY n.label ORDER BY coalesce(model_label, n.label) = n.label, n.doc_id) AS place FROM now n JOIN documents d USING (doc_id) WHERE status = 'labeled' AND n.label <> ''),
        f AS (SELECT *, 0 AS pass FROM x WHERE place <= 2), l AS (SELECT *, 1 AS pass FROM x WHERE place > 2 ORDER BY agrees, label, doc_id LIMIT 12 - (SELECT count(*) FROM f))
        SELECT doc_id, label, CASE WHEN model_label <> label THEN model_label END AS corrected_from FROM (SELECT * FROM f UNION ALL SELECT * FROM l)"""
    )
)
def fewshot_selection(spark, sf_dir):
    now = labels.current(inputs.label_log(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fewshot.select_examples(docs, labels.gold(now), now.select("doc_id", "model_label"), TAXONOMY.dimension(spark), per_class=2, max_examples=12)
    return out.select("doc_id", "label", "corrected_from")


@query(ORACLE_SQL["fewshot_selection"].replace("SELECT doc_id, label, CASE WHEN model_label <> label THEN model_label END AS corrected_from FROM", "SELECT label, count(*) AS n, count(CASE WHEN model_label <> label THEN 1 END) AS corrections FROM") + " GROUP BY label")
def fewshot_counts(spark, sf_dir):
    now = labels.current(inputs.label_log(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fewshot.counts(fewshot.select_examples(docs, labels.gold(now), now.select("doc_id", "model_label"), TAXONOMY.dimension(spark), per_class=2, max_examples=12))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def leakage(spark, sf_dir):
    return fewshot.leakage(table(spark, sf_dir, "labels").where("toxic = 1"), table(spark, sf_dir, "documents"))


# --- classification -------------------------------------------------------------------------------


@query(
    with_tables(
        """SELECT doc_id, CASE WHEN confidence <= CAST(0.9 AS DOUBLE) AND EXISTS (SELECT 1 FROM pairs WHERE (a = pred AND b = alt) OR (a = alt AND b = pred)) THEN alt END AS partner FROM scored"""
    )
)
def pair_partner(spark, sf_dir):
    """The institution that a tiebreak would set against the first choice, where it would take place."""
    return tiebreak.gated(inputs.predictions(spark, sf_dir), TAXONOMY).select("doc_id", F.when(F.col("adjudicate"), F.col("partner")).alias("partner"))


@query(
    with_tables(
        """x AS (SELECT pred, alt FROM scored WHERE confidence <= CAST(0.9 AS DOUBLE) AND EXISTS (SELECT 1 FROM pairs WHERE (a = pred AND b = alt) OR (a = alt AND b = pred)))
        SELECT count(*) AS adjudicated, count(*) FILTER (alt < pred) AS changed FROM x"""
    )
)
def tiebreak_counts(spark, sf_dir):
    """How many close calls a resolver that takes the first name is asked, and changes."""

    class Given:
        name = "given"

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decided = tiebreak.TiebreakClassifier(Given, lambda text, a, b: (min(a, b), 1.0, ""), TAXONOMY).resolve(inputs.predictions(spark, sf_dir), docs)
    return tiebreak.counters(decided)


_HITS = ", ".join(f"len(list_filter(regexp_extract_all(lower(text), '{classify.WORD}'), lambda w: w IN {words})) AS {lang}" for lang, words in classify.STOP_WORDS.items())
_TOTAL = " + ".join(classify.STOP_WORDS)


@query(
    f"""WITH h AS (SELECT doc_id, lang, {_HITS} FROM documents), t AS (SELECT *, {_TOTAL} AS total FROM h),
    l AS (SELECT doc_id, lang, unnest([{", ".join(f"{{'id': '{k}', 'n': {k}}}" for k in classify.STOP_WORDS)}], recursive := true), total FROM t),
    b AS (SELECT *, (n + 1) / (total + 4) AS confidence FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, id) = 1)
    SELECT doc_id, id AS institution_id, confidence, confidence < CAST(0.55 AS DOUBLE) AS needs_review, id = lang AS hit FROM b"""
)
def classify_by_words(spark, sf_dir):
    """Every document's language by its frequent words, gated by confidence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = classify.by_words(docs, classify.STOP_WORDS)
    return out.select("doc_id", "institution_id", "confidence", "needs_review", (F.col("institution_id") == F.col("lang")).alias("hit"))


@query()
def tfidf_baseline(spark, sf_dir):
    """Every document's language as a TF-IDF model trained on all documents sees it."""
    from sortarium.operators.baseline import Baseline

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("true_label"))
    model = Baseline().fit(docs.where("true_label <> ''"))
    return model.predict(docs).select("doc_id", "institution_id", F.round("confidence", 6).alias("confidence"), "needs_review")


@query("SELECT count(*) AS documents, count(DISTINCT source) AS sources, count(*) FILTER (lang <> 'en') AS hard, CAST(floor(sum(length(text)) / count(*)) AS BIGINT) AS mean_length FROM documents")
def corpus_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return reporting.corpus_stats(docs.select("text", F.col("source").alias("label"), (F.col("lang") != "en").alias("hard"))).select("documents", F.col("labels").alias("sources"), "hard", "mean_length")


# --- sources and sinks ----------------------------------------------------------------------------


def _written(spark, write) -> str:
    """The path of what write(path) leaves in a new folder that all executors share."""
    path = f"{session.scratch_folder(spark)}/rows.jsonl"
    write(path)
    return path


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text, 'plain' AS source, 1 AS page_count, lang AS true_label FROM documents")
def documents_round_trip(spark, sf_dir):
    """Documents as JSON lines and back, with the defaults that reading fills in."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), "text", F.col("lang").alias("true_label"))
    back = io.read_documents(spark, _written(spark, lambda path: io.write_jsonl(docs, path)))
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), "source", "page_count", "true_label")


@query(with_tables("SELECT CAST(doc_id AS VARCHAR) AS doc_id, pred AS institution_id, confidence, alt AS alternative, needs_review FROM scored"))
def predictions_round_trip(spark, sf_dir):
    rows = inputs.predictions(spark, sf_dir).drop("pm").withColumn("doc_id", F.col("doc_id").cast("string"))
    back = io.read_predictions(spark, _written(spark, lambda path: io.write_jsonl(rows, path)))
    return back.select("doc_id", "institution_id", "confidence", F.col("alternatives")[0]["institution_id"].alias("alternative"), "needs_review")


@query(with_tables("SELECT CAST(doc_id AS VARCHAR) AS doc_id, label, status, lane, model_label, seconds_spent, reviewer, count(*) AS n FROM log GROUP BY ALL"))
def label_log_round_trip(spark, sf_dir):
    """The log appended in two parts and read back; nothing in it is ever changed."""
    rows = inputs.label_log(spark, sf_dir).drop("seq").withColumn("doc_id", F.col("doc_id").cast("string"))

    def append(path):
        for part in (rows.where("reviewer = 'r0'"), rows.where("reviewer <> 'r0'")):
            io.append_labels(part, path)

    back = io.read_labels(spark, _written(spark, append))
    return back.groupBy("doc_id", "label", "status", "lane", "model_label", "seconds_spent", "reviewer").agg(F.count("*").alias("n"))


@query(with_tables(_QUEUE + " SELECT CAST(doc_id AS VARCHAR) AS doc_id, lane, pred AS model_label, [alt] AS alternatives, position FROM items"))
def queue_round_trip(spark, sf_dir):
    rows = _plain_queue(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string"))
    back = io.read_queue(spark, _written(spark, lambda path: io.write_jsonl(rows, path)))
    return back.select("doc_id", "lane", "model_label", "alternatives", "position")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5({sql_light('text')}) AS text, 'digital' AS source, lang AS label FROM documents")
def text_files_round_trip(spark, sf_dir):
    """One text file a document in a folder for each label, read back through the extractor of its suffix."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), "text", F.col("lang").alias("true_label"))
    path = _written(spark, lambda path: io.write_text_files(docs, path))
    back = io.read_files(spark, path)
    return back.select(F.regexp_replace("doc_id", "~[0-9]+$", "").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text"), "source", F.regexp_extract("path", "label=([^/]*)", 1).alias("label"))


@query("SELECT count(*) FILTER (toxic = 1) AS scanned FROM labels")
def scanned_count(spark, sf_dir):
    return io.scanned(table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "ocr").otherwise("digital").alias("source")))


# --- views ----------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('de', 'de', 'de'), ('en', 'en', 'en'), ('es', 'es', 'es'), ('fr', 'fr', 'fr')) t(institution_id, name_ar, name_en)")
def view_institutions(spark, sf_dir):
    return reporting.institutions(TAXONOMY, spark)


@query(with_tables("SELECT doc_id, pred AS institution, round(confidence, 2) AS confidence, CASE WHEN needs_review THEN 'review' ELSE 'auto' END AS route FROM scored ORDER BY doc_id LIMIT 40"))
def view_routing(spark, sf_dir):
    return reporting.routing(inputs.predictions(spark, sf_dir), TAXONOMY)


@query(ORACLE_SQL["eval_per_class"].replace("SELECT institution_id, ord, tp, fp, fn, support, p AS precision", "SELECT institution_id, support, p AS precision") + " WHERE support > 0")
def view_per_class(spark, sf_dir):
    return reporting.per_class(evaluate.per_class(joined(spark, sf_dir), TAXONOMY.dimension(spark)))


@query(f"SELECT *, CASE WHEN abs(gap) < 0.1 THEN 'ok' ELSE 'off' END AS flag FROM ({ORACLE_SQL['calibration_bins']})")
def view_reliability(spark, sf_dir):
    out = reporting.reliability(threshold.calibration_bins(joined(spark, sf_dir)))
    return out.withColumns({"mean_confidence": F.round("mean_confidence", 9), "gap": F.round("gap", 9)})


@query(
    f"""SELECT threshold, coverage, CASE WHEN auto_routed > 0 THEN printf('%.3f', auto_accuracy) ELSE '—' END AS auto_accuracy, misrouted, held, expected_cost,
    concat_ws(', ', CASE WHEN threshold = (SELECT threshold FROM ({ORACLE_SQL['recommend_cost']})) THEN 'cheapest' END, CASE WHEN threshold = (SELECT threshold FROM ({ORACLE_SQL['recommend_target']})) THEN 'target' END) AS mark
    FROM ({ORACLE_SQL['threshold_sweep']})"""
)
def view_sweep(spark, sf_dir):
    return reporting.sweep(threshold.sweep(joined(spark, sf_dir)), 0.95)


@query(f"SELECT institution_id, coalesce(printf('%.2f', threshold), '—') AS threshold, coverage, auto_accuracy, support, CASE WHEN thin THEN 'thin' ELSE '' END AS note FROM ({ORACLE_SQL['per_class_thresholds']})")
def view_class_thresholds(spark, sf_dir):
    return reporting.class_thresholds(threshold.per_class_thresholds(joined(spark, sf_dir), TAXONOMY.dimension(spark)))


@query(f"SELECT institution_id, have, need FROM ({ORACLE_SQL['label_coverage']})")
def view_coverage(spark, sf_dir):
    return reporting.coverage(labels.coverage(labels.current(inputs.label_log(spark, sf_dir)), TAXONOMY.dimension(spark)))


@query(f"SELECT doc_id, label, coalesce(corrected_from, '') AS corrected_from FROM ({ORACLE_SQL['fewshot_selection']})")
def view_examples(spark, sf_dir):
    now = labels.current(inputs.label_log(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return reporting.examples(fewshot.select_examples(docs, labels.gold(now), now.select("doc_id", "model_label"), TAXONOMY.dimension(spark), per_class=2, max_examples=12)).drop("chars")
