"""Text functions as Column builders: normalising, masking identifiers, cutting, rendering."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that the Python text model strips as white space.
SPACES = r"\t\n\x0b\x0c\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word character in the sense of Unicode letters, numbers and the underscore.
W = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<!{W})(?={W})|(?<={W})(?!{W}))"
D = r"\p{Nd}"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"\A[{SPACES}]+", ""), rf"[{SPACES}]+\z", "")


#: Marks that carry no meaning (directions and joiners, vowel signs, stretching), and letters and digits folded together.
_UNSEEN = re.compile("[\u200b-\u200f\u202a-\u202e\u2066-\u2069\ufeff\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u0640]+")
_FOLDED = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹" + "أإآٱىئیؤةک", "01234567890123456789" + "اااايييوهك")
_BLANKS, _GAPS, _OTHER = re.compile("[ \t\u00a0]{2,}|[\t\u00a0]"), re.compile("\n{3,}"), re.compile(rf"[^ء-ي0-9a-zA-Z{SPACES}]+")
_FOLDABLE = re.compile(f"[{''.join(map(chr, _FOLDED))}]")
#: What aggressive() makes of each ASCII character.
_PLAIN = bytes(ord(_OTHER.sub(" ", chr(c))) if c < 128 else c for c in range(256))


def light_text(text: str | None) -> str:
    """light() of one text."""
    if not text:
        return ""
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    text = _GAPS.sub("\n\n", _BLANKS.sub(" ", text))
    return "\n".join([line.strip() for line in text.split("\n")]).strip()


def aggressive_text(text: str | None) -> str:
    """aggressive() of one text."""
    text = light_text(text)
    if text.isascii():
        return _BLANKS.sub(" ", text.encode().translate(_PLAIN).decode()).strip()
    if _FOLDABLE.search(text):
        text = text.translate(_FOLDED)
    return _BLANKS.sub(" ", _OTHER.sub(" ", text)).strip()


def _by_text(run, text: Column) -> Column:
    """run, a function of one text, on batches of texts; a null text counts as none."""

    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([run(t) for t in batch.to_pylist()], pa.string())

    return F.arrow_udf(texts, StringType())(text)


def light(text: Column) -> Column:
    """Noise removed that carries no meaning: presentation forms, marks, stretching, repeated blanks.

    Unicode's normal forms have no built-in function; as the texts are in Python for them, the rest is done there too.
    """
    return _by_text(light_text, text)


def aggressive(text: Column) -> Column:
    """light() folded for bags of words: digits to ASCII, letter variants together, the rest to blanks."""
    return _by_text(aggressive_text, text)


def looks_arabic(text: Column, threshold: float = 0.2) -> Column:
    """Whether Arabic letters make up at least `threshold` of the letters; false without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    arabic = F.regexp_count(text, F.lit(r"[\p{L}&&[\u0600-ۿ]]"))
    return F.coalesce((letters > 0) & (arabic >= F.lit(threshold) * letters), F.lit(False))


@dataclass(frozen=True)
class Rule:
    """A kind of identifier: what finds it, what stands for it, and a cheap test without which it can't occur."""

    name: str
    pattern: str
    placeholder: str
    gate: str


_DIGITS = rf"{D}{{9}}"
#: The identifiers and their placeholders, most specific first.
RULES = (
    Rule("email", rf"{EDGE}[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.]+{EDGE}", "[بريد]", "@"),
    Rule("iban", rf"(?iu)(?<!{W})SA{D}{{22}}(?!{W})", "[آيبان]", _DIGITS),
    Rule("tax_number", rf"(?<!{W})3{D}{{14}}(?!{W})", "[رقم ضريبي]", _DIGITS),
    Rule("phone", rf"(?:\+?966|00966|0)5{D}{{8}}(?!{W})", "[جوال]", _DIGITS),
    Rule("national_id", rf"(?<!{W})[12]{D}{{9}}(?!{W})", "[رقم هوية]", _DIGITS),
    Rule("long_number", rf"(?<!{W}){D}{{9,}}(?!{W})", "[رقم]", _DIGITS),
)


def bound(value: Column, then) -> Column:
    """then(value) with value computed once, however often `then` names it."""
    return F.element_at(F.transform(F.array(value), lambda x: then(x)), 1)


def masked(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Identifiers replaced by their placeholders, rule by rule; rules whose gate doesn't open are not tried.

    Neighbouring rules of one gate are skipped together. Patterns repeat classes, not groups, for Java
    matches a repeated group by recursion, and a long run would overflow the stack.
    """
    out = text
    for gate, group in groupby(rules, lambda r: r.gate):
        out = bound(out, lambda before, gate=gate, group=tuple(group): F.when(before.rlike(gate), _replaced(before, group)).otherwise(before))
    return out


def _replaced(text: Column, rules: tuple[Rule, ...]) -> Column:
    for rule in rules:
        text = F.regexp_replace(text, rule.pattern, rule.placeholder)
    return text


def redaction(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct<text, hits>: the masked text, and how often each rule hit what the rules before it left.

    Texts are masked once. Only where that changed something, which is rare, are the rules followed one by one to see which
    did; so no placeholder may be the very text that it stands for.
    """
    hits = []
    for k, rule in enumerate(rules):
        before = masked(text, rules[:k])
        hits.append(F.when(before.rlike(rule.gate), F.regexp_count(before, F.lit(rule.pattern))).otherwise(F.lit(0)))
    none = F.array(*[F.lit(0)] * len(rules))
    return bound(masked(text, rules), lambda after: F.struct(after.alias("text"), F.when(after == text, none).when(text.isNull(), none).otherwise(F.array(*hits)).alias("hits")))


def scan(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """map<rule, hits> of the rules that hit."""
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(r.name) for r in rules]), redaction(text, rules)["hits"]), lambda _, n: n > 0)


def summarize(counts: Column) -> Column:
    """'a=1, b=2' of a map, by name; a sentence if it is empty."""
    parts = F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return bound(F.array_join(parts, ", "), lambda line: F.when(line == "", F.lit("no identifiers found")).otherwise(line))


#: Sizes and strings of a prepared text.
MAX_CHARS, HEAD_CHARS, TAIL_CHARS = 24_000, 16_000, 4_000
EMPTY = "[الوثيقة فارغة أو تعذّرت قراءتها]"


def head_and_tail(text: Column, most: int = MAX_CHARS) -> Column:
    """Texts over `most` characters without their middle; the note says how much that was."""
    gone = (F.length(text) - HEAD_CHARS - TAIL_CHARS).cast("string")
    cut = F.concat(F.substring(text, 1, HEAD_CHARS), F.lit("\n\n[... حُذف "), gone, F.lit(" حرفاً من وسط الوثيقة ...]\n\n"), F.right(text, F.lit(TAIL_CHARS)))
    return F.when(F.length(text) > most, cut).otherwise(text)


def prepared(text: Column, redact: bool = True) -> Column:
    """What a request may hold of a text: stripped, masked, and then cut, so that no identifier survives a cut."""
    return bound(strip(F.coalesce(text, F.lit(""))), lambda bare: F.when(bare == "", F.lit(EMPTY)).otherwise(bound(masked(bare) if redact else bare, head_and_tail)))


def envelope(text: Column, source: Column, pages: Column, redact: bool = True) -> Column:
    origin = F.when(source == "digital", F.lit("نص رقمي")).otherwise(F.lit("نص مستخرج ضوئياً (قد يحتوي أخطاء)"))
    return F.concat(
        F.lit("مصدر النص: "), origin, F.lit("\nعدد الصفحات: "), pages.cast("string"), F.lit("\n--- بداية الوثيقة ---\n"), prepared(text, redact), F.lit("\n--- نهاية الوثيقة ---")
    )


def example_text(text: Column, max_chars: int = 700, redact: bool = True) -> Column:
    """An example's text: masked before it is cut, so that a cut can't leave the tail of an identifier.

    (Cutting first and masking afterwards would leave such tails; only there do the two orders differ.)
    """
    bare = strip(text)
    whole = masked(bare) if redact else bare
    cut = F.concat(F.regexp_replace(F.substring(whole, 1, max_chars), rf"[{SPACES}]+\z", ""), F.lit(" …"))
    return F.when(F.length(bare) > max_chars, cut).otherwise(whole)


def file_name(doc_id: Column) -> Column:
    return F.regexp_replace(doc_id, "[^A-Za-z0-9_.-]", "_")


#: Pairs of Arabic letters that scans confuse.
CONFUSED = ("بت", "حج", "دذ", "رز", "سش", "صض", "عغ")


def ocr_noise(text: Column, seed: Column, rate: float = 0.02) -> Column:
    """Seeded scan errors: per character one draw decides on a confused letter, a lost one, or a broken line."""
    table = "".join(CONFUSED), "".join(b + a for a, b in CONFUSED)
    chars = F.split(text, "")

    def one(c: Column, i: Column) -> Column:
        r = F.pmod(F.xxhash64(seed, i), F.lit(1_000_000)) / 1e6
        swapped = F.translate(c, *table)
        return F.when((r < rate) & (swapped != c), swapped).when((r < 1.4 * rate) & c.rlike(r"\p{L}"), "").when((r < 1.6 * rate) & (c == " "), "\n").otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def json_of_reply(reply: str) -> dict:
    """The JSON object of a model's reply: bare, fenced, or the widest braces in prose; ValueError if there is none."""
    text = reply.strip()
    fenced = re.match(r"^```(?:json)?\s*(.*?)\s*```", text, re.DOTALL)
    braces = re.search(r"\{.*\}", text, re.DOTALL)
    for candidate in (fenced and fenced[1], text, braces and braces[0]):
        try:
            found = json.loads(candidate or "")
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    raise ValueError("no JSON object in the reply")


def json_column(reply: Column, schema: str) -> Column:
    """json_of_reply as a Column: null where there is no such object."""
    text = strip(reply)
    inner = F.regexp_replace(F.regexp_replace(text, r"\A```(?:json)?\s*", ""), r"\s*```\z", "")
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))
    return F.coalesce(valid(inner), valid(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))
