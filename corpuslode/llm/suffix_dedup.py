"""Removal of repeated byte strings by column-wise construction of multi-document suffix orders.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts
somewhere else, in the same document or another; matches never cross
documents, overlaps count, and strings are judged on the input.

A whole collection's suffix order cannot be built column by column in one
place, so the strings are first dealt into independent small collections.
Each string of LENGTH bytes is owned by an anchor: of its ``GRAM``-byte grams
the one with the smallest hash, the last one on ties. The choice depends on
the string alone, so equal strings have equal anchors at equal offsets and
only the owners of equal grams need to meet. An anchor's strings start in one
run of at most LENGTH - GRAM + 1 places; the bytes they cover are its segment.
Anchors whose gram occurs once in the corpus end here. Equal segments of one
gram are one class with a count.

Then comes the construction. The segments of a task's grams are aligned at
their anchors and built from the last column to the first: each round inserts
one symbol per segment in front of its suffix. The symbols in suffix order are
the round's part of the collection's Burrows-Wheeler transform; a stable sort
by symbol within each gram gives the next suffix order, and the common prefix
of two neighbours is one more than the smallest common prefix between their
old places, or zero. A string is repeated if its suffix has LENGTH bytes in
common with a neighbour, or its class has a count above one. Since a segment
is at most 2 * LENGTH bytes and a batch a fixed number of segments, the arrays
of a round stay in memory; between the stages, all passes go through
sequential files that Spark writes and reads.

A gram with more than ``HOT`` classes would not fit one task. Its segments are
split by further context: an anchor's starts are halved into those near to it
and those far from it, so that the strings of each half have more bytes around
the anchor in common, and segments are grouped by these bytes. Equal strings stay
in one group; groups that are still too large are halved again. When the strings
of a group have all their bytes in common there is one class left, with a count.

Classes are told apart by 128 bits (of gram and segment), groups by 64 bits more.
Null text is empty; texts below LENGTH bytes lose nothing; long texts are hashed
piece by piece, whole. Rows that share an id are told apart by a 64-bit hash of
their text; rows equal in both (null ids too) are documents of their own that
repeat each other: one of them stands for their segments, and their marks are
gathered once, so that work and rows grow in proportion to their number. Empty
tables give empty results. Other columns may have any names; they
are not read by ``spans`` and pass ``without_repeats`` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.llm.common import bounded_batches, cut, free_name, scratch, slices, tidy

LENGTH = 200
GRAM = 20
#: Classes of one gram above which its segments are split by more context.
HOT = 20_000
#: Segments that are built together.
BATCH = 20_000

_WINDOW = LENGTH - GRAM + 1
_PIECE = 1 << 19  # bytes of a document that are hashed at once
_LOW = np.uint64((1 << 20) - 1)
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _piece(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a piece of bytes: each anchor's place, first and last owned start, gram hash and segment hash."""
    up, down = _power(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_VALUE[a] * up[: len(a)], out=sums[1:])
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(a) - GRAM + 1])
    key = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    low, width = key, 1
    while 2 * width <= _WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(key) - _WINDOW + 1], low[_WINDOW - width :])
    owner = (_LOW - (low & _LOW)).astype(np.int64)
    first = np.r_[0, np.flatnonzero(owner[1:] != owner[:-1]) + 1]
    last = np.r_[first[1:] - 1, len(owner) - 1]
    at = owner[first]
    segment = (sums[last + LENGTH] - sums[first]) * down[first] + (at - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return at, first, last, grams[at], _mix(segment ^ (last - first).astype(np.uint64))


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, segment hash, place) of the anchors of a document; a place holds the anchor and its run, see ``_unpack``."""
    n, found = len(raw), []
    a = np.frombuffer(raw, np.uint8)
    for low in range(0, max(n - LENGTH + 1, 0), _PIECE):
        at, first, last, gram, segment = _piece(a[low : low + _PIECE + LENGTH - 1])
        found.append((gram.view(np.int64), segment.view(np.int64), (low + at) << 16 | (at - first) << 8 | (last - first)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _unpack(at: int) -> tuple[int, int, int]:
    """First owned start, how far the anchor is behind it, and owned starts less one."""
    place, back, more = at >> 16, at >> 8 & 255, at & 255
    return place - back, back, more


def repeated(bodies: list[bytes], back: np.ndarray, more: np.ndarray, group: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which owned starts of each segment are repeated, as rows of booleans.

    ``bodies``: the segments, those of a group side by side and all different;
    ``back``: their anchors' offsets; ``more``: owned starts less one.
    """
    m, left = len(bodies), _WINDOW - 1
    columns = left + LENGTH
    symbols = np.zeros((m, columns), np.uint16)  # 0: not in the segment
    for i, body in enumerate(bodies):
        symbols[i, left - back[i] : left - back[i] + len(body)] = np.frombuffer(body, np.uint8)
    lengths = np.array([len(b) for b in bodies])
    inside = np.arange(columns)[None, :]
    inside = (inside >= (left - back)[:, None]) & (inside < (left - back + lengths)[:, None])
    symbols = np.where(inside, symbols + 1, 0).T.copy()
    out = np.zeros((m, _WINDOW), bool)
    order, group = np.arange(m), group.astype(np.int64) * 512
    common = np.zeros(m + 1, np.int32)  # of each suffix with the one before it
    for c in range(columns - 1, -1, -1):
        bwt = symbols[c][order]
        key = group[order] + bwt
        move = np.argsort(key, kind="stable")
        key, here = key[move], bwt[move]
        low = np.zeros(m + 1, np.int32)
        same = np.flatnonzero((key[1:] == key[:-1]) & (here[1:] > 0)) + 1
        a, b = move[same - 1] + 1, move[same]
        value = common[b].copy()
        if (far := np.flatnonzero(b > a)).size:
            value[far] = np.minimum.reduceat(common, np.stack([a[far], b[far] + 1], 1).ravel())[::2]
        low[same] = np.minimum(value + 1, LENGTH)
        order, common = order[move], low
        if c <= left:
            hit = np.maximum(common[:-1], common[1:]) >= LENGTH
            if hit.any():
                rows = order[hit]
                start = c - left + back[rows]
                ok = (start >= 0) & (start <= more[rows])
                out[rows[ok], start[ok]] = True
    out[count > 1] = True
    out &= np.arange(_WINDOW)[None, :] <= more[:, None]
    return out


def _runs(flags: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return (edge - np.tile([0, 1], len(edge) // 2)).tolist()


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in the order of their groups -> (h, c, runs), a bounded number at a time and groups never cut."""
    names = ["h", "c", "body", "back", "more", "n"]

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h = t["h"].to_numpy()
        group = np.r_[0, np.cumsum(h[1:] != h[:-1])]
        flags = repeated(t["body"].to_pylist(), t["back"].to_numpy(), t["more"].to_numpy(), group, t["n"].to_numpy())
        some = np.flatnonzero(flags.any(axis=1))
        runs = pa.array([_runs(flags[i]) for i in some], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(t["c"].to_numpy()[some]), runs], ["h", "c", "runs"])

    held = None
    for b in batches:
        t = pa.Table.from_batches([b.select(names)])
        held = t if held is None else pa.concat_tables([held, t])
        while held.num_rows > BATCH:
            h = held["h"].to_numpy()
            ends = np.flatnonzero(h[1:] != h[:-1]) + 1
            ends = ends[ends <= BATCH] if (ends <= BATCH).any() else ends[:1]
            if not ends.size:
                break
            yield from done(held.slice(0, int(ends[-1])).combine_chunks())
            held = held.slice(int(ends[-1]))
    if held is not None and held.num_rows:
        yield from done(held.combine_chunks())


def _halves(width: int):
    """Splits segments into those of narrower runs of starts, at most ``width`` places each, and names the group of their common bytes.

    A start that lies p bytes before its anchor has at least p bytes on the left
    of the anchor and the rest of LENGTH on its right. Of the starts with p from a
    to b - 1 all strings have a bytes on the left and LENGTH - GRAM - b + 1 behind the gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for h, c, body, back, more, n in zip(*(batch.column(x).to_pylist() for x in ("h", "c", "body", "back", "more", "n")), strict=True):
                for a in range((back - more) // width * width, back + 1, width):
                    first, last = max(back - a - width + 1, 0), min(back - a, more)
                    part, at = body[first : last + LENGTH], back - first
                    common = body[back - a : back + LENGTH - a - width + 1]
                    group = xxhash.xxh64_intdigest(common, (h ^ a * 0x9E3779B97F4A7C15) % (1 << 64))
                    name = xxhash.xxh64_intdigest(part, at << 16 | last - first)
                    out.append((h, c, first, group - (1 << 63), name - (1 << 63), part, at, last - first, n))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
            names = ["h", "c", "first", "group", "name", "body", "back", "more", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _constructed(segments: DataFrame, width: int = _WINDOW) -> DataFrame:
    """``segments``: h (their group), c, body, back, more, n; starts of at most ``width`` places. Returns h, c and the runs of repeated starts."""
    sizes = cut(segments.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > HOT).select("h"), "repeats-hot")
    build = lambda x: x.repartition("h").sortWithinPartitions("h").mapInArrow(_build, "h long, c long, runs array<int>")
    if width == 1 or sizes.isEmpty():
        return build(segments)
    width = -(-width // 2)
    kinds = "h long, c long, first int, group long, name long, body binary, back int, more int, n long"
    parts = cut(segments.join(sizes, "h", "left_semi").select("h", "c", "body", "back", "more", "n").mapInArrow(_halves(width), kinds), "repeats-halves")
    # segments that are equal in this part are one class now
    classes = parts.groupBy("group", "name").agg(F.first("body").alias("body"), F.first("back").alias("back"), F.first("more").alias("more"), F.sum("n").alias("n"))
    found = cut(_constructed(cut(classes.select(F.col("group").alias("h"), F.col("name").alias("c"), "body", "back", "more", "n"), "repeats-parts"), width), "repeats-part-runs")
    found = parts.select("h", "c", "first", "group", "name").join(found.toDF("group", "name", "runs"), ["group", "name"])
    runs = found.select("h", "c", F.expr("transform(runs, i -> i + first)").alias("runs")).groupBy("h", "c").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return build(segments.join(sizes, "h", "left_anti")).union(runs)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, check (a hash of its text), n_bytes, body (its text, packed) and marks, the repeated starts.

    body and marks are null for a document without a repeated gram; then sha256 is that of the whole text.
    """
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("check", F.xxhash64("text"))
    kind = dict(d.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [anchors(t.encode()) for t in b.column("text").to_pylist()]
            rows = np.repeat(np.arange(b.num_rows), [len(x[0]) for x in found])
            h, c, at = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(3))
            lead = np.r_[True, rows[1:] != rows[:-1]][: len(rows)]
            columns = [pa.array(h), pa.array(c), b.column("doc_id").take(pa.array(rows)), b.column("check").take(pa.array(rows)), pa.array(at), pa.array(lead)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "c", "doc_id", "check", "at", "lead"])

    path = scratch(docs.sparkSession, "repeats")
    with tidy(docs.sparkSession):
        every = cut(d.select("doc_id", "text", "check").mapInArrow(scan, f"h long, c long, doc_id {kind}, check long, at long, lead boolean"), "repeats-anchors")
        # written, so that the join is a stage of its own and Spark can split a gram that many documents share
        twice = cut(every.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "repeats-grams")
        met = cut(every.join(twice, "h"), "repeats-met")
        classes = met.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "check", "at")).alias("r"))
        classes = cut(classes.select("h", "c", "n", "r.*"), "repeats-classes")

        # texts meet what is asked of them once: nothing, or the segments that stand for their classes
        same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["check"] == b["check"])
        # of rows with one id and text all grams meet, so their first anchors tell how many there are
        asked = cut(met.groupBy("doc_id", "check").agg(F.count_if("lead").alias("any")), "repeats-asked")
        stand = classes.groupBy("doc_id", "check").agg(F.collect_list(F.struct("h", "c", "at", "n")).alias("stand"))
        asked = asked.join(stand, same(asked, stand), "left").select(asked["doc_id"], asked["check"], "any", "stand")
        packed = d.mapInArrow(_pack, f"doc_id {kind}, check long, n_bytes long, body binary")
        told = packed.join(asked, same(packed, asked), "left").select(packed["doc_id"], packed["check"], "n_bytes", "body", "any", "stand")
        out = "kind int, doc_id %s, check long, n_bytes long, sha256 string, body binary, h long, c long, back int, more int, n long" % kind
        told.mapInArrow(_cut_out, out).write.partitionBy("kind").parquet(path)
        stored = docs.sparkSession.read.schema(out).parquet(path)

        segments = stored.where("kind = 1").select("h", "c", "body", "back", "more", "n")
        twins = cut(asked.where("any > 1").select("doc_id", "check"), "repeats-twins")
        if not twins.isEmpty():
            # rows with one id and text stand for a class once: one of them is taken, before anything is shuffled where tasks hold several
            one = packed.join(twins, same(packed, twins), "left_semi").groupBy("doc_id", "check").agg(F.first("n_bytes").alias("n_bytes"), F.first("body").alias("body"))
            one = one.join(stand, same(one, stand)).select(one["doc_id"], one["check"], "n_bytes", "body", F.lit(1).cast("long").alias("any"), "stand")
            segments = segments.union(cut(one.mapInArrow(_cut_out, out).where("kind = 1").select(*segments.columns), "repeats-twin-segments"))
        runs = _constructed(segments)
        marks = met.join(cut(runs, "repeats-runs"), ["h", "c"]).groupBy("doc_id", "check").agg(F.collect_set(F.struct("at", "runs")).alias("marks"))
        marks = cut(marks, "repeats-marks", keep=True)
    whole = stored.where("kind = 0").select("doc_id", "check", "n_bytes", "sha256", "body")
    return whole.join(marks, same(whole, marks), "left").select(whole["doc_id"], whole["check"], "n_bytes", "sha256", "body", "marks")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zstd = zstandard.ZstdCompressor(level=1)
    for b in batches:
        raw = [t.encode() for t in b.column("text").to_pylist()]
        n = pa.array(map(len, raw), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("check"), n, pa.array(map(zstd.compress, raw), pa.binary())], ["doc_id", "check", "n_bytes", "body"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (kind 0; their body only if something of it met another), and the segments that stand for classes (kind 1)."""
    zstd = zstandard.ZstdDecompressor()
    kinds = [pa.int32(), None, pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    names = ["kind", "doc_id", "check", "n_bytes", "sha256", "body", "h", "c", "back", "more", "n"]
    for whole in batches:
        for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            rows = []
            for key, check, n, body, any_, stand in zip(*(b.column(x).to_pylist() for x in ("doc_id", "check", "n_bytes", "body", "any", "stand")), strict=True):
                raw = zstd.decompress(body) if n else b""
                rows.append((0, key, check, n, hashlib.sha256(raw).hexdigest(), body if any_ is not None else None, None, None, None, None, None))
                # of rows with one id and text, ``find`` takes one by itself
                for s in stand if stand and any_ < 2 else ():
                    first, back, more = _unpack(s["at"])
                    rows.append((1, None, None, None, None, raw[first : first + more + LENGTH], s["h"], s["c"], back, more, s["n"]))
            kinds[1] = b.schema.field("doc_id").type
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _kept(body: bytes | None, n: int, marks) -> tuple[bytes, list[tuple[int, int]]]:
    """A document's bytes and its maximal repeated runs as (first, end)."""
    raw = zstandard.ZstdDecompressor().decompress(body) if n else b""
    change = np.zeros(n + 1, np.int32)
    for m in marks or ():
        first, _, _ = _unpack(m["at"])
        r = np.array(m["runs"], np.int64).reshape(-1, 2) + first
        np.add.at(change, r[:, 0], 1)
        np.add.at(change, r[:, 1] + LENGTH, -1)
    edge = np.flatnonzero(np.diff(np.r_[False, np.cumsum(change[:n]) > 0, False].astype(np.int8)))
    return raw, list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _left(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in spans)]
    return b"".join(raw[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(raw)], strict=True))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document, and its removed runs as (first, end)."""
    found = find(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_removed, n_spans, sha, kept = [], [], [], []
            for n, whole, body, marks in zip(*(b.column(x).to_pylist() for x in ("n_bytes", "sha256", "body", "marks")), strict=True):
                raw, cuts = _kept(body, n, marks) if marks else (b"", [])
                n_removed.append(sum(e - s for s, e in cuts))
                n_spans.append(len(cuts))
                sha.append(hashlib.sha256(_left(raw, cuts)).hexdigest() if cuts else whole)
                kept.append([{"first": s, "end": e} for s, e in cuts])
            columns = [b.column("doc_id"), b.column("n_bytes"), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_spans:
                columns.append(pa.array(kept, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    more = ", spans array<struct<first: long, end: long>>" if with_spans else ""
    return found.mapInArrow(run, f"doc_id {dict(found.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")


def _whole_characters(raw: bytes, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without characters of which only a part is repeated."""
    out = []
    for s, e in cuts:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e < len(raw) and e > s and raw[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all its rows and columns, with the repeated strings taken out of its texts (whole characters only; null stays null)."""
    found = find(docs, id_col, text_col).where("marks IS NOT NULL").dropDuplicates(["doc_id", "check"])
    kind = dict(found.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for n, body, marks in zip(*(b.column(x).to_pylist() for x in ("n_bytes", "body", "marks")), strict=True):
                raw, cuts = _kept(body, n, marks)
                texts.append(_left(raw, _whole_characters(raw, cuts)).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("check"), pa.array(texts, pa.string())], ["id", "check", "text"])

    of, check, key, text = (free_name(x, docs) for x in ("id", "check", "hash", "text"))
    new = found.mapInArrow(run, f"id {kind}, check long, text string").toDF(of, check, text)
    old = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    out = old.join(new, F.col(f"`{id_col}`").eqNullSafe(F.col(of)) & (F.col(key) == F.col(check)), "left")
    return out.select(*[F.coalesce(F.col(text), F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
