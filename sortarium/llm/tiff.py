"""TIFF media columns: directories are walked, strips and tiles decoded, predictors undone, one row a page.

The reader takes either byte order, PackBits, LZW, deflate (both codes) and plain data, strips and
tiles, chunky and planar samples of 8 or 16 bits, and the horizontal predictor. The writer makes files of 8-bit grey pages
in any of these schemes.

A null or empty file gives no rows, a file that can't be read one row with its error (and null
samples) after the pages before the damage. Repeated rows give equal pages. Only the key columns and
the page's own are returned, so columns of other names can't clash. A page is decoded by itself;
memory is bounded by the file and its largest page.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the format: compression codes, and bytes of the types that directories use here.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
_TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}
_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


class BadTiff(ValueError):
    pass


@dataclass
class Page:
    """samples: height x (width * channels), uint8 or uint16."""

    width: int
    height: int
    channels: int
    compression: int
    predictor: int
    tiled: bool
    samples: np.ndarray


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for k in range(at, end, 128):
            part = data[k : min(end, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUN.finditer(data):
        literal(run.start())
        at = run.end()
        out.append(257 - (at - run.start()))
        out.extend(run[1])
    literal(len(data))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def lzw_pack(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table and 257 ends."""
    out, acc, n, bits = bytearray(), 256, 9, 9
    table: dict[int, int] = {}
    free, prefix = 258, -1

    def put(code: int) -> None:
        nonlocal acc, n
        acc, n = (acc << bits) | code, n + bits
        while n >= 8:
            n -= 8
            out.append(acc >> n)
            acc &= (1 << n) - 1

    for b in data:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        table[key] = free
        free += 1
        prefix = b
        if free == 4095:
            put(256)
            table.clear()
            free, bits = 258, 9
        elif free == (1 << bits):
            bits += 1
    if prefix >= 0:
        put(prefix)
        free += 1
        if free == (1 << bits) and bits < 12:
            bits += 1
    put(257)
    if n:
        out.append((acc << (8 - n)) & 255)
    return bytes(out)


def lzw_unpack(data: bytes, size: int) -> bytes:
    base = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, done, acc, n, bits, last = list(base), [], 0, 0, 0, 9, b""
    for byte in data:
        acc, n = (acc << 8) | byte, n + 8
        if n < bits:
            continue
        n -= bits
        code, acc = acc >> n, acc & ((1 << n) - 1)
        if code == 256:
            table, bits, last = list(base), 9, b""
            continue
        if code == 257 or done >= size:
            break
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise BadTiff("LZW code out of range")
        if last:
            table.append(last + entry[:1])
        out.append(entry)
        done += len(entry)
        last = entry
        # The width grows one entry early: the encoder is one entry ahead.
        if len(table) + 1 >= (1 << bits) and bits < 12:
            bits += 1
    return b"".join(out)


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise BadTiff(f"deflate: {e}") from None
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == LZW:
        return lzw_unpack(data, size)
    raise BadTiff(f"compression {compression}")


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    try:
        (n,) = struct.unpack_from(f"{order}H", data, at)
        tags = {}
        for k in range(n):
            entry = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, entry)
            if kind not in _TYPES:
                continue
            form = f"{order}{count}{_TYPES[kind]}"
            where = entry + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(f"{order}I", data, entry + 8)[0]
            if struct.calcsize(form) > len(data):
                raise BadTiff("a tag is longer than the file")
            tags[tag] = struct.unpack_from(form, data, where)
        return tags, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]
    except struct.error:
        raise BadTiff("directory beyond the end") from None


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages of a file in order; raises BadTiff at the first that can't be read."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        raise BadTiff("not a TIFF")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at:
        if at in seen:
            raise BadTiff("directories form a circle")
        seen.add(at)
        tags, at = _directory(data, at, order)
        yield _page(data, tags, order)


def _page(data: bytes, tags: dict[int, tuple[int, ...]], order: str) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        if tag in tags and tags[tag]:
            return tags[tag][0]
        if default is None:
            raise BadTiff(f"tag {tag} is missing")
        return default

    width, height, channels = one(256), one(257), one(277, 1)
    compression, predictor, planes = one(259, 1), one(317, 1), one(284, 1)
    depths = set(tags.get(258, (1,)))
    if depths not in ({8}, {16}):
        raise BadTiff(f"bits per sample {sorted(depths)}")
    if predictor not in (1, 2):
        raise BadTiff(f"predictor {predictor}")
    kind = np.dtype(f"{order}u{depths.pop() // 8}")
    together, sheets = (channels, 1) if planes == 1 else (1, channels)
    tiled = 322 in tags
    across, down = (one(322), one(323)) if tiled else (width, min(one(278, height), height) or 1)
    starts, sizes = (tags.get(324, ()), tags.get(325, ())) if tiled else (tags.get(273, ()), tags.get(279, ()))
    if not across or not down or not 0 < width * height * channels <= 1 << 31:
        raise BadTiff("bad dimensions")
    columns, rows = -(-width // across), -(-height // down)
    if len(starts) != columns * rows * sheets or len(sizes) != len(starts):
        raise BadTiff("wrong number of strips or tiles")
    out = np.zeros((height, width, channels), kind.newbyteorder("="))
    for k, (start, size) in enumerate(zip(starts, sizes)):
        sheet, cell = divmod(k, columns * rows)
        top, left = cell // columns * down, cell % columns * across
        tall = down if tiled else min(down, height - top)
        need = tall * across * together * kind.itemsize
        block = _unpack(data[start : start + size], compression, need)
        if len(block) < need:
            raise BadTiff("a strip or tile is too short")
        cells = np.frombuffer(block, kind, tall * across * together).astype(kind.newbyteorder("=")).reshape(tall, across, together)
        if predictor == 2:
            cells = np.cumsum(cells, axis=1, dtype=cells.dtype)
        part = out[top : top + tall, left : left + across]
        chosen = cells[: part.shape[0], : part.shape[1]]
        if planes == 1:
            part[:] = chosen
        else:
            part[:, :, sheet] = chosen[:, :, 0]
    return Page(width, height, channels, compression, predictor, tiled, out.reshape(height, width * channels))


def write_pages(pages: list[np.ndarray], schemes: list[tuple[int, int, bool]], order: str = "<", down: int = 32, across: int = 64) -> bytes:
    """A file of 8-bit grey pages; schemes: (compression, predictor, tiled) of each."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0" * 4)
    link = 4
    for image, (compression, predictor, tiled) in zip(pages, schemes):
        height, width = image.shape
        wide = across if tiled else width
        starts, sizes = [], []
        for top in range(0, height, down):
            for left in range(0, width, wide):
                cells = image[top : top + down, left : left + wide]
                if tiled:
                    cells = np.pad(cells, ((0, down - cells.shape[0]), (0, wide - cells.shape[1])))
                if predictor == 2:
                    cells = np.diff(cells, axis=1, prepend=np.zeros((len(cells), 1), np.uint8))
                raw = cells.tobytes()
                packed = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_pack, DEFLATE: zlib.compress, OLD_DEFLATE: zlib.compress}[compression](raw)
                starts.append(len(out))
                sizes.append(len(packed))
                out += packed
        out += b"\0" * (len(out) % 2)
        short = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor])]
        places = [(322, 4, [wide]), (323, 4, [down]), (324, 4, starts), (325, 4, sizes)] if tiled else [(273, 4, starts), (278, 4, [down]), (279, 4, sizes)]
        entries = sorted(short + places)
        here = len(out)
        struct.pack_into(f"{order}I", out, link, here)
        behind = here + 2 + 12 * len(entries) + 4
        body, extra = bytearray(struct.pack(f"{order}H", len(entries))), bytearray()
        for tag, kind, values in entries:
            packed = struct.pack(f"{order}{len(values)}{_TYPES[kind]}", *values)
            body += struct.pack(f"{order}HHI", tag, kind, len(values))
            if len(packed) <= 4:
                body += packed.ljust(4, b"\0")
            else:
                body += struct.pack(f"{order}I", behind + len(extra))
                extra += packed
        link = here + len(body)
        out += body + b"\0" * 4 + extra
        out += b"\0" * (len(out) % 2)
    return bytes(out)


#: How the pages of a text are stored; a page's own checksum chooses, so equal texts give equal files.
SCHEMES = tuple((c, p, tiled) for c in (DEFLATE, PACKBITS) for p in (1, 2) for tiled in (False, True))[:7] + ((LZW, 1, False),)
WIDTH, PAGE_ROWS = 192, 128


def text_to_tiff(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, file): the text in UTF-8, filled up with blanks to whole rows, in pages of PAGE_ROWS rows."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    image = np.frombuffer(raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH)), np.uint8).reshape(-1, WIDTH)
    pages = [image[k : k + PAGE_ROWS] for k in range(0, len(image), PAGE_ROWS)]
    return len(raw), write_pages(pages, [SCHEMES[zlib.crc32(p) % len(SCHEMES)] for p in pages])


PAGE = "page int, width int, height int, channels int, compression int, predictor int, tiled boolean, samples binary, error string"


def pages(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row a page of every file: the key, PAGE's columns; samples are row by row, 16-bit ones little-endian."""
    kind = files.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch[key], batch[media]):
                rows = []
                try:
                    for k, p in enumerate(read_pages(data) if data else ()):
                        rows.append((name, k, p.width, p.height, p.channels, p.compression, p.predictor, p.tiled, p.samples.astype(p.samples.dtype.newbyteorder("<")).tobytes(), None))
                except BadTiff as e:
                    rows.append((name, len(rows), None, None, None, None, None, None, None, str(e)))
                if rows:
                    yield pd.DataFrame(rows, columns=[key, *(c.split()[0] for c in PAGE.split(", "))]).astype({c: "Int32" for c in ("page", "width", "height", "channels", "compression", "predictor")})

    return files.select(key, media).mapInPandas(decode, f"`{key}` {kind}, {PAGE}")


def _feature(found: list[Page]) -> str:
    """What the decoded samples look like, over all pages: size, sums and steps between neighbours."""
    total = sum(int(p.samples.sum(dtype=np.int64)) for p in found)
    steps = sum(int(np.abs(np.diff(p.samples.astype(np.int16), axis=1)).sum(dtype=np.int64)) for p in found)
    shades = sum(np.bincount(p.samples.ravel() >> 5, minlength=8) for p in found)
    return f"pages={len(found)};rows={sum(p.height for p in found)};sum={total};steps={steps};shades={','.join(map(str, shades))}"


def digests(docs: DataFrame) -> DataFrame:
    """Every text stored as TIFF and read back through read_pages: sizes, checksums and features of what was read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.doc_id, batch.text):
                n, media = text_to_tiff(text)
                found = list(read_pages(media))
                payload = b"".join(p.samples.tobytes() for p in found)
                rows.append((name, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), _feature(found)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kinds.split(", ")])

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInPandas(run, kinds)
