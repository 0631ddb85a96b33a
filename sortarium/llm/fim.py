"""Fill-in-the-middle: texts are cut in three and put together anew around sentinels, by one scan of a byte automaton.

The automaton's table is built from the sentinels and UTF-8: it knows how many continuation bytes are still to come, how
much of a sentinel has been read, and whether a line has just begun. Each transition says whether it begins a unit (a code
point or a line) and whether it completes a sentinel; these are counted by text and by block of bytes. A second
pass finds the byte of a cut by the counts of the blocks and then inside one block.

A state depends on the last few bytes alone (`Scanner.memory`), so all blocks of a slice of texts, joined by a byte that
UTF-8 doesn't use, are scanned at once, each from so many bytes before its begin.

Null and empty texts, texts with a sentinel in them and rows without a draw (a null key) stay plain. Repeated rows get
equal results, an empty table an empty one. Of the caller's columns only one named like the added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortarium.llm.common import slices, tidied


@dataclass(frozen=True)
class Settings:
    """Sentinels before the prefix, the suffix and the middle; percent of texts that are cut; percent of those with the suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 90
    suffix_first: int = 20
    seed: int = 1
    unit: str = "char"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if not all(m.isascii() and m and "\n" not in m for m in marks) or self.unit not in ("char", "line"):
            raise ValueError("sentinels are ASCII without line feeds, units char or line")
        if len(set(marks)) < 3 or any(a[k:] and (b.startswith(a[k:]) or a[k:].startswith(b)) for a in marks for b in marks for k in range(len(a)) if k or a != b):
            raise ValueError("no sentinel may begin inside another")


FOUND = "units long, form string, prefix_units long, middle_units long, output string"
#: A byte that UTF-8 never uses, between texts.
END = 0xFF
_BEGINS, _SENTINEL = 1, 2


class Scanner:
    """The table: next state and emission by state and class of byte."""

    block, piece = 128, 1 << 19

    def __init__(self, sentinels: tuple[str, ...], unit: str):
        letters = sorted({c for s in sentinels for c in s.encode()})
        # classes: end, continuation, leads of 2, 3 and 4 bytes, line feed, other ASCII, then one for each letter of a sentinel
        end, cont, lead, feed, other, own = 0, 1, 2, 5, 6, 7
        kind = np.full(256, other, np.intp)
        kind[0x80:0xC0], kind[0xC0:0xE0], kind[0xE0:0xF0], kind[0xF0:], kind[END], kind[10] = cont, lead, lead + 1, lead + 2, end, feed
        for k, c in enumerate(letters):
            kind[c] = own + k
        # states: a text or line has just begun, somewhere in it, 1 to 3 continuation bytes to come, then beginnings of sentinels
        beginnings = sorted({s.encode()[:k] for s in sentinels for k in range(1, len(s))})
        fresh, inside, number = 0, 1, {b: 5 + k for k, b in enumerate(beginnings)}
        wide = own + len(letters)
        step, emit = np.zeros((5 + len(beginnings), wide), np.intp), np.zeros((5 + len(beginnings), wide), np.uint8)
        whole = {s.encode() for s in sentinels}
        read = {v: b for b, v in number.items()}
        for state in range(len(step)):
            so_far = read.get(state, b"")
            for c in range(wide):
                if c == end:
                    step[state, c] = fresh
                    continue
                if c == cont:
                    step[state, c] = {3: 2, 4: 3}.get(state, inside)
                elif c in (lead, lead + 1, lead + 2):
                    step[state, c] = 2 + c - lead
                elif c == feed:
                    step[state, c] = fresh
                elif c == other:
                    step[state, c] = inside
                else:
                    now = so_far + bytes([letters[c - own]])
                    emit[state, c] |= _SENTINEL * any(now.endswith(w) for w in whole)
                    step[state, c] = next((number[now[k:]] for k in range(len(now)) if now[k:] in number), inside)
                if unit == "line" and state == fresh or unit == "char" and c != cont:
                    emit[state, c] |= _BEGINS
        self.kind, self.step, self.emit = kind, (step * wide).ravel(), emit.ravel()
        self.memory = max(3, *(len(s) for s in sentinels))

    def scan(self, stream: np.ndarray) -> np.ndarray:
        """What every byte's transition emits, from the start of a text; all blocks of a piece of the stream take a step at a time."""
        out, back = np.empty(len(stream), np.uint8), self.memory
        for at in range(0, len(stream), self.piece):
            some = stream[max(0, at - back) : at + self.piece]
            n = min(len(stream) - at, self.piece)
            blocks = -(-n // self.block)
            bytes_ = np.full(back + blocks * self.block, END, np.uint8)
            bytes_[back + n - len(some) : back + n] = some
            rows = np.lib.stride_tricks.as_strided(bytes_, (back + self.block, blocks), (1, self.block))
            state, place, said = np.zeros(blocks, np.intp), np.empty(blocks, np.intp), np.empty((self.block, blocks), np.uint8)
            for j in range(back + self.block):
                np.add(state, self.kind[rows[j]], out=place)
                np.take(self.step, place, out=state)
                if j >= back:
                    np.take(self.emit, place, out=said[j - back])
            out[at : at + n] = said.T.ravel()[:n]
        return out


@cache
def scanner(sentinels: tuple[str, ...], unit: str) -> Scanner:
    return Scanner(sentinels, unit)


class Counted:
    """Counts of emissions by text, and by block up to each block, of some texts."""

    size = 256

    def __init__(self, texts: list[bytes], s: Scanner):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        said = s.scan(np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8))
        self.begins = (said & _BEGINS).astype(bool)
        blocks = np.add.reduceat(self.begins, np.arange(0, len(said), self.size), dtype=np.int64)
        self.before = np.append(0, np.cumsum(blocks))
        self.first = self._up_to(self.starts)
        self.units = self._up_to(self.ends) - self.first
        hits = np.flatnonzero(said & _SENTINEL)
        self.sentinels = np.searchsorted(hits, self.ends) - np.searchsorted(hits, self.starts)

    def _up_to(self, places: np.ndarray) -> np.ndarray:
        """Units begun before each place."""
        k = places // self.size
        return self.before[k] + np.array([np.count_nonzero(self.begins[b * self.size : p]) for b, p in zip(k.tolist(), places.tolist())], np.int64)

    def cut(self, text: int, units: int) -> int:
        """The byte of a text at which its unit number `units` begins, or its end."""
        if units >= self.units[text]:
            return int(self.ends[text] - self.starts[text])
        nth = int(self.first[text]) + units
        b = int(np.searchsorted(self.before, nth, "right")) - 1
        inside = np.flatnonzero(self.begins[b * self.size : (b + 1) * self.size])
        return b * self.size + int(inside[nth - int(self.before[b])]) - int(self.starts[text])


def draws(key: Column, seed: int) -> Column:
    """Four numbers below 2**32 for every key, null for a null one."""
    hex_ = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return F.when(key.isNotNull(), F.array(*(F.conv(F.substring(hex_, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4))))


def transformed(docs: DataFrame, want: Settings = Settings(), key: str = "doc_id", text: str = "text", into: str = "fim") -> DataFrame:
    """docs with a struct `into` of FOUND: units, form (plain, psm or spm), units of prefix and middle (null if plain) and the output."""
    marks = tuple(m.encode() for m in (want.prefix, want.suffix, want.middle))

    @tidied
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        s = scanner((want.prefix, want.suffix, want.middle), want.unit)
        for texts, drawn in batches:
            units, forms, firsts, middles, outs = [], [], [], [], []
            drawn = drawn.to_pylist()
            for part, some in slices(texts, 256):
                raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in some]
                counted = Counted(raw, s)
                for k, (t, h) in enumerate(zip(raw, drawn[part])):
                    n = int(counted.units[k])
                    units.append(n)
                    if not t or counted.sentinels[k] or h is None or h[2] % 100 >= want.rate:
                        forms.append("plain")
                        firsts.append(None)
                        middles.append(None)
                        outs.append(t)
                        continue
                    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    at, to = counted.cut(k, a), counted.cut(k, b)
                    ends = [marks[0] + t[:at], marks[1] + t[to:]]
                    forms.append("spm" if h[3] % 100 < want.suffix_first else "psm")
                    firsts.append(a)
                    middles.append(b - a)
                    outs.append(b"".join([*(ends[::-1] if forms[-1] == "spm" else ends), marks[2], t[at:to]]))
            out = pa.array(outs, pa.binary()).cast(pa.string())
            yield pa.StructArray.from_arrays([pa.array(units, pa.int64()), pa.array(forms, pa.string()), pa.array(firsts, pa.int64()), pa.array(middles, pa.int64()), out], names=[c.split()[0] for c in FOUND.split(", ")])

    def columns(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from run(batches)

    return docs.withColumn(into, F.arrow_udf(columns, FOUND)(F.col(text), draws(F.col(key), want.seed)))


def restored(output: Column, form: Column, want: Settings = Settings()) -> Column:
    """The text from which an output of that form was made.

    Cut texts hold no sentinel, and none can arise where a piece meets one, since none begins inside another.
    """
    found = F.split(output, "|".join(f"\\Q{m}\\E" for m in (want.prefix, want.suffix, want.middle)), -1)
    # found: nothing, then the pieces in their order
    order = F.when(form == "spm", F.array(F.lit(2), F.lit(3), F.lit(1))).when(form == "psm", F.array(F.lit(1), F.lit(3), F.lit(2)))
    return F.when(form == "plain", output).otherwise(F.concat(*(F.get(found, order[k]) for k in range(3))))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, units, form, lengths of prefix and middle, and digests of the output and of the text restored from it."""
    rows = transformed(docs.select("doc_id", "text")).select("doc_id", "fim.*")
    return rows.select(
        "doc_id", F.col("units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
