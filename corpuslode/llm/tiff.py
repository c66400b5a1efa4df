"""TIFF pages as rows: a writer for 8-bit grey pages and a reader that walks image directories.

The reader follows the chain of directories of either byte order, joins strips
or tiles of a page, undoes PackBits, LZW and deflate and the horizontal
predictor, and gives one row per page with width, height and samples. The
writer stores samples losslessly in any of these forms.

``encode`` lays bytes out as rows of 576 samples and pages of at most
``PAGE_ROWS`` rows, so no single page grows with a text, however long it is.
The form of a page, its compression, predictor and strips or tiles, is chosen
among ``FORMS`` by a hash of its samples, so all of them occur at all sizes and
equal inputs give equal files.

A file that is null or no TIFF gives no page. A page whose directory or data
are damaged gives a row with null samples and the reason in ``error``: what a
directory claims is held against the bytes that are there before anything is
allocated. Repeated rows give equal pages. Empty tables give empty results;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslode.llm.common import bounded_batches

ROW = 576
PAGE_ROWS = 4
STRIP_ROWS = 2
TILE = (192, 16)

# Fixed values of the format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODES = {1: "B", 3: "H", 4: "I"}
#: No compression of the format makes its data larger than this, times what is stored.
MOST_GROWTH = 4096
#: (compression, horizontal predictor?, tiled?) of pages.
FORMS = (
    (DEFLATE, True, False), (DEFLATE, False, True), (DEFLATE, False, False), (DEFLATE, True, True),
    (PACKBITS, False, False), (PACKBITS, True, True), (LZW, False, False), (LZW, True, False),
)


class DamagedError(ValueError):
    """The file does not hold what its directory says."""


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more as (count, byte), the rest as literals of at most 128."""
    a = np.frombuffer(data, np.uint8)
    out = bytearray()
    if not len(a):
        return b""
    starts = np.r_[0, np.flatnonzero(a[1:] != a[:-1]) + 1]
    lengths = np.diff(np.r_[starts, len(a)])
    literal = 0  # where the open literal begins

    def flush(end: int) -> None:
        nonlocal literal
        for i in range(literal, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for s, n in zip(starts[lengths >= 3].tolist(), lengths[lengths >= 3].tolist(), strict=True):
        flush(s)
        for i in range(0, n, 128):
            k = min(128, n - i)
            out += bytes((0, data[s])) if k == 1 else bytes((257 - k, data[s]))
        literal = s + n
    flush(len(data))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the width grows one code early, as the format has it."""
    first = {bytes((i,)): i for i in range(256)}
    table, width, bits, held, out = dict(first), 9, 256, 9, bytearray()
    next_code, prefix = 258, b""

    def put(code: int) -> None:
        nonlocal bits, held
        bits = bits << width | code
        held += width
        while held >= 8:
            held -= 8
            out.append(bits >> held)
            bits &= (1 << held) - 1

    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix])
        table[longer] = next_code
        next_code += 1
        prefix = data[i : i + 1]
        if next_code == 4095:
            put(256)
            table, width, next_code = dict(first), 9, 258
        elif next_code + 1 > 1 << width:
            width += 1
    if prefix:
        put(table[prefix])
        next_code += 1
        if next_code + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, bits, held, out, last = list(first), 9, 0, 0, bytearray(), b""
    for byte in data:
        bits = bits << 8 | byte
        held += 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise DamagedError("an LZW code before its entry")
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out)


def _pack(data: bytes, how: int) -> bytes:
    return {NONE: bytes, LZW: pack_lzw, DEFLATE: zlib.compress, PACKBITS: pack_bits}[how](data)


def _unpack(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        out = data[:size]
    elif how == LZW:
        out = unpack_lzw(data, size)
    elif how in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise DamagedError(str(e)) from e
    elif how == PACKBITS:
        out = unpack_bits(data, size)
    else:
        raise DamagedError(f"compression {how}")
    if len(out) < size:
        raise DamagedError(f"{len(out)} of {size} bytes")
    return out[:size]


def write(pages: list[tuple[np.ndarray, int, bool, bool]]) -> bytes:
    """A little-endian file. A page is (grey samples as rows, compression, horizontal predictor?, tiled?)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for grey, how, predict, tiled in pages:
        height, width = grey.shape
        tw, th = TILE if tiled else (width, STRIP_ROWS)
        blocks = []
        for y in range(0, height, th):
            for x in range(0, width, tw):
                part = grey[y : y + th, x : x + tw]
                if tiled:  # edges are filled up to whole tiles
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1])), mode="edge")
                if predict:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                blocks.append(_pack(part.tobytes(), how))
        offsets = []
        for b in blocks:
            offsets.append(len(out))
            out += b
        counts = [len(b) for b in blocks]
        tags = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8]), (COMPRESSION, [how]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [2 if predict else 1])]
        tags += [(TILE_WIDTH, [tw]), (TILE_LENGTH, [th]), (TILE_OFFSETS, offsets), (TILE_COUNTS, counts)] if tiled else [(STRIP_OFFSETS, offsets), (ROWS_PER_STRIP, [th]), (STRIP_COUNTS, counts)]
        fields = b""
        for tag, values in sorted(tags):
            data = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                at = len(out)
                out += data
                data = struct.pack("<I", at)
            fields += struct.pack("<HHI", tag, 4, len(values)) + data
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + fields
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The tags of each directory; none for one that the file does not hold whole."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        return
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0] if at + 2 <= len(data) else 0
        if not n or at + 2 + 12 * n + 4 > len(data):
            yield {}
            return
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            place = at + 10 + 12 * i
            if SIZES.get(kind, 1) * count > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            if kind in CODES and place + SIZES[kind] * count <= len(data):
                tags[tag] = list(struct.unpack_from(f"{order}{count}{CODES[kind]}", data, place))
        yield tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _first(tags: dict[int, list[int]], tag: int, default: int | None = None) -> int:
    found = tags.get(tag) or ([] if default is None else [default])
    if not found:
        raise DamagedError(f"tag {tag}")
    return found[0]


def _page(data: bytes, tags: dict[int, list[int]]) -> tuple[int, int, np.ndarray]:
    width, height, samples = _first(tags, WIDTH), _first(tags, HEIGHT), _first(tags, SAMPLES, 1)
    if set(tags.get(BITS, [1])) != {8} or _first(tags, PLANAR, 1) != 1:
        raise DamagedError("not 8-bit samples side by side")
    tiled = TILE_OFFSETS in tags
    if tiled:
        offsets, counts, tw, th = tags[TILE_OFFSETS], tags.get(TILE_COUNTS, []), _first(tags, TILE_WIDTH), _first(tags, TILE_LENGTH)
    else:
        offsets, counts, tw, th = tags.get(STRIP_OFFSETS, []), tags.get(STRIP_COUNTS, []), width, min(_first(tags, ROWS_PER_STRIP, height), height)
    if not (width and height and samples and tw and th):
        raise DamagedError("a size of zero")
    across, down = -(-width // tw), -(-height // th)
    blocks = across * down
    if min(len(offsets), len(counts)) < blocks:
        raise DamagedError("strips or tiles are missing")
    if any(o + n > len(data) for o, n in zip(offsets[:blocks], counts[:blocks], strict=True)):
        raise DamagedError("strips or tiles behind the end")
    if max(width * height, tw * th * (blocks if tiled else 1)) * samples > MOST_GROWTH * sum(counts[:blocks]):
        raise DamagedError("more samples than the data can hold")
    how, predict = _first(tags, COMPRESSION, 1), _first(tags, PREDICTOR, 1) == 2
    grey = np.empty((height, width, samples), np.uint8)
    for i in range(blocks):
        y, x = i // across * th, i % across * tw
        rows = th if tiled else min(th, height - y)
        raw = _unpack(data[offsets[i] : offsets[i] + counts[i]], how, rows * tw * samples)
        part = np.frombuffer(raw, np.uint8).reshape(rows, tw, samples)
        if predict:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        grey[y : y + th, x : x + tw] = part[: height - y, : width - x]
    return width, height, grey


def read(data: bytes | None) -> Iterator[tuple[int, int | None, int | None, bytes | None, str | None]]:
    """(page, width, height, samples row by row, error) of each page; of a damaged one the sizes that a row can hold."""
    for number, tags in enumerate(_directories(data or b"")):
        try:
            width, height, grey = _page(data, tags)
            yield number, width, height, grey.tobytes(), None
        except DamagedError as e:
            width, height = (x[0] if x and x[0] < 1 << 31 else None for x in (tags.get(WIDTH), tags.get(HEIGHT)))
            yield number, width, height, None, str(e)


def encode(payload: bytes, page_rows: int = PAGE_ROWS) -> bytes:
    """Bytes (a positive multiple of ROW) as grey pages, the form of each chosen by a hash of its samples."""
    grey = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    parts = [grey[y : y + page_rows] for y in range(0, len(grey), page_rows)]
    return write([(p, *FORMS[zlib.crc32(p.tobytes()) % len(FORMS)]) for p in parts])


def pages(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """One row per page of each file: its id, of any type, page, width, height, samples and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [(key, *page) for page in read(data)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), [b.column(0).type, *types], strict=True)], names)

    d = files.selectExpr(f"`{id_col}` AS id", f"`{data_col}` AS data")
    names = ["id", "page", "width", "height", "samples", "error"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    return d.mapInArrow(run, f"id {dict(d.dtypes)['id']}, page int, width int, height int, samples binary, error string")


def store_text(text: str | None) -> tuple[int, bytes]:
    """Length of the text in bytes, and the file that holds it, filled with bytes 255 up to whole rows."""
    raw = (text or "").encode()
    return len(raw), encode(raw + b"\xff" * (-len(raw) % ROW if raw else ROW))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Each text stored as a TIFF file and read back: sizes, hashes and a feature of the samples, and the file itself if asked for."""
    bounded_batches(docs.sparkSession)
    d = docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS string) AS text")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_pages", "feature"]

    def row(text: str | None) -> tuple:
        n, media = store_text(text)
        found = list(read(media))
        if any(p[3] is None for p in found):
            raise DamagedError("a page that was just written")
        payload = b"".join(p[3] for p in found)
        shades = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        mean = int((shades * np.arange(256)).sum() * 1000 // len(payload))
        feature = f"pages={len(found)};rows={sum(p[2] for p in found)};mean={mean};shades={int((shades > 0).sum())};top={int(shades.argmax())}"
        out = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), len(found), feature)
        return (*out, media) if with_media else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.binary()]
        for whole in batches:
            for b in [whole.slice(i, 512) for i in range(0, whole.num_rows, 512)]:
                found = [row(t) for t in b.column("text").to_pylist()]
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names + ["media"] * with_media)

    more = ", media binary" if with_media else ""
    return d.mapInArrow(
        run,
        f"doc_id {dict(d.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        f"media_bytes long, media_sha256 string, n_pages int, feature string{more}",
    )
