"""BPE encoding by a bounded-lookahead streaming transducer, and decoding by an incremental state machine.

A string's encoding is the one split into tokens of which every two neighbours are compatible: merging
the two of them alone never joins anything across their border. So the last token of the encoding of
each prefix follows from the prefixes before it: the transducer reads symbol by symbol, an automaton
names the tokens that end there, and the one that is compatible with its left neighbour is the last.

What comes later can change the end of a prefix's encoding, but only so far back. A difference travels
to the left by merges that compete for a symbol, each of a later rank than the one that caused it; the
longest such chain that the merge list allows gives the sufficient lookahead. Tokens that end so many
symbols before what has been read are stable: they are emitted and forgotten, so memory depends on the
merge list and not on the text.

Texts are cut at white space, which no token crosses; a run without white space is normalised whole
before its symbols pass the transducer. Words met again come from a table of bounded size.

Null counts as the empty text and gives no tokens. Repeated rows give equal results. The strings of
the special tokens in a text become those tokens. An empty table gives no rows. Extra columns pass
through; added columns replace those of the same name.
"""

from __future__ import annotations

import bisect
import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortarium.llm.common import HELD, slices, tidied

#: White space as the tokenizer's file means it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What newer property tables call letters or numbers and the tokenizer's library does not (ranges).
_NO_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_NO_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))
#: Marks that the library's normaliser doesn't know (ranges): it neither moves them nor joins them to a letter.
_NO_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85),
    (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0),
    (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1),
    (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
#: Lower case as the library has it where Python's tables are older; a final sigma is no case of its own.
_LOWER = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def _without(name: str, ranges: tuple[tuple[int, int], ...]) -> str:
    return rf"[\p{{{name}}}--[{''.join(f'{chr(a)}-{chr(b)}' for a, b in ranges)}]]"


_LETTER, _NUMBER = _without("L", _NO_LETTERS), _without("N", _NO_NUMBERS)
_SPACES = regex.compile(f"[{_SPACE}]+")
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_WORDS = regex.compile(rf"{_SHORT}|{_LETTER}+|{_NUMBER}|[^{_SPACE}{_LETTER}{_NUMBER}]+", regex.V1)
#: The same for lower-cased texts whose characters all lie in Latin-1, without property tables.
_LATIN = re.compile(f"{_SHORT}|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t\n\x0b\x0c\r \x85\xa0a-z0-9ªµº²³¹¼½¾ß-öø-ÿ]+")


_MARKS = re.compile(f"([{''.join(f'{chr(a)}-{chr(b)}' for a, b in _NO_MARKS)}])")


def _composed(text: str) -> str:
    """The text in normal form C, as the library has it."""
    return "".join(unicodedata.normalize("NFC", part) for part in _MARKS.split(text))


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if visible, else the next free one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_SYMBOLS = _byte_symbols()
_FROM_LATIN = dict(enumerate(_SYMBOLS))
_TO_BYTE = {c: b for b, c in enumerate(_SYMBOLS)}
#: Stands behind the last symbol of a word; no symbol of a byte.
_END = "\ue000"


class Merges:
    """An ordered merge list: which tokens there are, what they were merged from, and which may be neighbours.

    tokens is an automaton over the tokens that occur: it gives (token, number of symbols), a word's end being one.
    lookahead is the number of symbols that must be known behind a token for it to be stable.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str):
        n = max(vocabulary.values(), default=0) + 1
        self.end, self.bits = end, max(1, n).bit_length()
        self.rank, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.pairs: dict[int, int] = {}
        made = []
        for r, (a, b) in enumerate(merges):
            a, b, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.pairs.setdefault(a << self.bits | b, r)
            if self.rank[whole] < 0:
                self.left[whole], self.right[whole], self.rank[whole] = a, b, r
                made.append(whole)
        self._fits: dict[int, bool] = {}
        # A token that its own merges would not build never occurs.
        usable = [self.rank[v] < 0 for v in range(n)]
        for whole in made:
            a, b = self.left[whole], self.right[whole]
            usable[whole] = usable[a] and usable[b] and self._apart(a, b, self.rank[whole])
        self.tokens = ahocorasick.Automaton()
        size = [0] * n
        for t, v in vocabulary.items():
            symbols = t.removesuffix(end) if end else t
            size[v] = len(symbols)
            if symbols and usable[v] and (self.rank[v] >= 0 or len(symbols) == 1):
                ended = end and t.endswith(end)
                self.tokens.add_word(symbols + _END if ended else symbols, (v, len(symbols) + bool(ended)))
        self.tokens.make_automaton()
        self.lookahead = self._lookahead(usable, size)

    def _lookahead(self, usable: list[bool], size: list[int]) -> int:
        """The sufficient lookahead: the symbols of the longest chain of merges in which each could undo the one before.

        A merge (a, b) of rank r can fail only because a merge of a lower rank takes a last part of b first: b
        itself, or a token t on its right edge before t's own merge into something larger. That one needs what
        stands behind t, of which the same holds in turn. Going through the merges by rank, the reach of each is
        the size of its right part and the longest reach of what can undo that part.
        """
        ranks: dict[int, list[int]] = {}
        reach: dict[int, list[int]] = {}
        most, mask = 0, (1 << self.bits) - 1
        for pair, r in sorted(self.pairs.items(), key=lambda x: x[1]):
            a, b = pair >> self.bits, pair & mask
            if not (usable[a] and usable[b]):
                continue
            further, t, before = 0, b, r
            while t >= 0:
                if t in ranks and (k := bisect.bisect_left(ranks[t], before)):
                    further = max(further, reach[t][k - 1])
                before = min(before, self.rank[t])
                t = self.right[t]
            own = size[b] + further
            ranks.setdefault(a, []).append(r)
            longest = reach.setdefault(a, [])
            longest.append(max(own, longest[-1]) if longest else own)
            most = max(most, own)
        return most

    def _apart(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether no merge of a rank below limit joins a symbol of a to one of b, while both are built.

        Undoes the later of the two last merges again and again; of equal ranks, the one on the right.
        """
        rank, pairs, bits = self.rank, self.pairs, self.bits
        while True:
            joined = pairs.get(a << bits | b)
            if joined is not None and joined < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                limit, a = ra, self.right[a]
            elif rb >= 0:
                # A merge across the border stands to the left of b's own merge, so it wins at equal rank.
                limit, b = rb + 1, self.left[b]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        key = a << self.bits | b
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) >= 200_000:
                self._fits.clear()
            found = self._fits[key] = self._apart(a, b)
        return found


class Transducer:
    """Symbols in, stable tokens out. One word at a time: feed() its parts, then close(); or whole() for all at once."""

    #: Symbols held beyond the lookahead before stable tokens are looked for.
    EVERY = 256
    _START, _OPEN = -2, -1

    def __init__(self, merges: Merges):
        self.m = merges
        self.found = merges.tokens.iter("")
        self.reset()

    def reset(self) -> None:
        #: The last token of each prefix and where it begins; places count from `base`, the end of what was emitted.
        self.last, self.begin, self.base, self.new = [self._START], [0], 0, True

    def _read(self, symbols: str) -> None:
        last, begin, base, m = self.last, self.begin, self.base, self.m
        last.extend([self._OPEN] * len(symbols))
        begin.extend([0] * len(symbols))
        known, bits = m._fits, m.bits
        self.found.set(symbols, self.new)
        self.new = False
        for end, (token, size) in self.found:
            at = end + 1 - base
            if last[at] == -1 and at >= size:
                left = last[at - size]
                if left >= 0:
                    fits = known.get(left << bits | token)
                    if fits is None:
                        fits = m.fits(left, token)
                    if not fits:
                        continue
                elif left == -1:
                    continue
                last[at], begin[at] = token, at - size

    def feed(self, symbols: str) -> list[int]:
        """Tokens that have become stable. The last symbol so far may yet end the word, so it counts as unknown."""
        self._read(symbols)
        known = len(self.last) - 2
        if known <= self.m.lookahead + self.EVERY:
            return []
        out, at = [], known
        while at > known - self.m.lookahead:
            at = self._from(at)
        point = at
        while at:
            out.append(self.last[at])
            at = self._from(at)
        if point:
            self.last, self.begin = self.last[point:], [b - point for b in self.begin[point:]]
            self.base += point
        return out[::-1]

    def _from(self, at: int) -> int:
        if self.last[at] < 0:
            raise ValueError("no encoding: a symbol isn't in the vocabulary")
        return self.begin[at]

    def close(self) -> list[int]:
        """The tokens of what is left of the word."""
        if self.m.end and (len(self.last) > 1 or self.base):
            self._read(_END)
        return self._rest()

    def _rest(self) -> list[int]:
        out, at, last, begin = [], len(self.last) - 1, self.last, self.begin
        while at:
            if last[at] < 0:
                raise ValueError("no encoding: a symbol isn't in the vocabulary")
            out.append(last[at])
            at = begin[at]
        self.reset()
        out.reverse()
        return out

    def whole(self, symbols: str, part: int = 1024) -> list[int]:
        if len(symbols) <= self.m.lookahead + self.EVERY:
            # Nothing would be emitted before the end.
            self._read(symbols + _END if self.m.end and symbols else symbols)
            return self._rest()
        out = []
        for k in range(0, len(symbols), part):
            out += self.feed(symbols[k : k + part])
        return out + self.close()


class _Words(dict):
    """word -> tokens, for words of up to KEPT characters met of late: a full table becomes the old one, which is asked once more."""

    KEPT = 40

    def __init__(self, merges: Merges, most: int = 120_000):
        super().__init__()
        self.transducer, self.most, self.old = Transducer(merges), most, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = self.old.get(word)
        if out is None:
            symbols = word if word.isascii() and word.isprintable() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_FROM_LATIN)
            out = tuple(self.transducer.whole(symbols))
        if len(word) <= self.KEPT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


class Codec:
    """The tokenizer of a file of the tokenizers library: lower-cased words of byte symbols with a word end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.words = _Words(Merges(model["vocab"], merges, model.get("end_of_word_suffix") or ""))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = [""] * (max(*model["vocab"].values(), *self.special.values(), 0) + 1)
        for t, v in chain(model["vocab"].items(), self.special.items()):
            self.token[v] = t
        self.end = model.get("end_of_word_suffix") or ""
        self.digits = list(map(str, range(len(self.token))))

    def _piece(self, text: str) -> Iterator[int]:
        try:
            text.encode("latin-1")
            words = _LATIN.findall(text.lower())
        except UnicodeEncodeError:
            words = _WORDS.findall(_composed(text).translate(_LOWER).lower())
        return chain.from_iterable(map(self.words.__getitem__, words))

    def pieces(self, texts: Iterator[str], size: int = 1 << 16) -> Iterator[list[int]]:
        """Tokens of a text that comes in parts, as they become known."""
        held = ""
        for part in texts:
            held += part
            while len(held) > size:
                found = None
                for found in _SPACES.finditer(held, 0, size):
                    pass
                found = found or _SPACES.search(held, size)
                if found is None or found.end() == len(held):
                    break
                yield self.piece(held[: found.start()])
                held = held[found.end() :]
        yield self.piece(held)

    def piece(self, text: str) -> list[int]:
        if self.split is None or "<|" not in text:
            return list(self._piece(text))
        return [i for part in self.split.split(text) if part for i in ([self.special[part]] if part in self.special else self._piece(part))]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return self.piece(text) if len(text) <= 1 << 16 else list(chain.from_iterable(self.pieces(iter([text]))))


class Decoder:
    """Tokens in, text out, with no more state than the bytes of one open character.

    With joined=True the result is what the library's decode() gives for a file without a decoder: the
    tokens' own strings with a blank between them. Else it is the text that the bytes spell, with a
    blank for every word end; bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self, codec: Codec, joined: bool = False):
        self.codec, self.joined, self.first = codec, joined, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        token = self.codec.token
        if self.joined:
            text = " ".join(map(token.__getitem__, ids))
            text = text if self.first or not ids else f" {text}"
            self.first = self.first and not ids
            return text
        out, end = bytearray(), self.codec.end
        for i in ids:
            t = token[i]
            if t in self.codec.special:
                out += t.encode()
            else:
                ended = bool(end) and t.endswith(end)
                out += bytes(_TO_BYTE[c] for c in (t.removesuffix(end) if ended else t))
                out += b" " * ended
        return self.utf8.decode(bytes(out))

    def close(self) -> str:
        return "" if self.joined else self.utf8.decode(b"", True)


owned = partial(tidied, owner="bpe")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a file, kept by each Python worker until another operator's stage runs there."""
    HELD["bpe"] = codec.cache_clear
    return Codec(path)


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs and a column ids, the tokens of the text; tokens of a few hundred rows at most are in hand at a time."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != "ids"]).add("ids", T.ArrayType(T.IntegerType(), False))
    docs = docs.select(*[f.name for f in schema.fields[:-1]])

    @owned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for rows, texts in slices(batch.column(text), 256):
                part = batch.slice(rows.start, len(texts))
                found = [np.array(c.encode(t), np.int32) for t in texts]
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in found])), pa.int32()), pa.array(np.concatenate(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str, joined: bool = False) -> DataFrame:
    """rows and a column decoded, the text of the column ids."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for batch in batches:
            out = []
            for ids in batch:
                d = Decoder(c, joined)
                out.append(d.feed([] if ids is None else list(ids)) + d.close())
            yield pd.Series(out, dtype=object)

    return rows.withColumn("decoded", text("ids"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, text by text through encoder and decoder."""

    @owned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = []
            for _, texts in slices(batch.column("text"), 256):
                for text in texts:
                    d, n, ids_hash, text_hash = Decoder(c, joined=True), 0, hashlib.sha256(), hashlib.sha256()
                    for ids in c.pieces(iter([text or ""])):
                        ids_hash.update(((" " if n and ids else "") + " ".join(map(c.digits.__getitem__, ids))).encode())
                        text_hash.update(d.feed(ids).encode("utf-8", "surrogatepass"))
                        n += len(ids)
                    text_hash.update(d.close().encode())
                    rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
            n, ids, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
