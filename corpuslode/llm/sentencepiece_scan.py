"""SentencePiece unigram encoding and decoding; giant documents by a max-plus parallel scan.

The best segmentation of a text is a longest path: position to position by a
vocabulary piece, with the piece's score. In the max-plus algebra the scores
of a stretch of text form a matrix, and matrices of adjoining stretches
multiply in any grouping.

A document of more than ``CHUNK`` characters is cut into chunks of that size,
wherever that falls. A chunk's boundary state is how far a piece that began
before reaches into it, at most the longest piece less one. Each chunk yields
its transfer matrix from entry to exit states. The matrices of ``SPAN`` chunks
are multiplied in a tree by one task, those of a document's spans, small against
its text, by another; from the entry scores of the spans each span has those of
its chunks, by prefix products in a tree again. With these a chunk finds which
entry state each exit state comes from; these maps compose as the matrices do,
from the end and by spans too, give each chunk its exit state, and it is traced
back on its own. Ties are decided as in one pass from the left (the piece that
starts first), so the cuts never show in the result. Scores are integers, so
sums are exact in any order.

No piece crosses the place before a run of spaces, so all paths meet there. The
units between two such places (see ``token_counts``) are traced one by one, and
each worker keeps what it has traced, within a bound. Of a chunk only what
stands before the first and behind the last of these places has states; a
chunk without one is relaxed whole from each entry state. A shorter document is
a single chunk.

The vocabulary is read from a SentencePiece model file. A unigram model's own
scores are used, in units of 2^-10. A BPE file has ranks in place of
probabilities: a piece of rank r then scores minus the logarithm of r + 2. So
``encode`` gives the ids of the unigram model over that vocabulary, which are
not the merges of the BPE model. The library itself adds scores up in 32-bit floats
and so can miss the best path of a long text by a few units. A character outside
the vocabulary becomes its UTF-8 bytes.

``decode`` gives the text of any column of ids back. Null and empty text have no
ids, and these decode to empty text; null ids decode to null. U+2581 in a text
is a space, as the library has it. Repeated rows get equal ids. Empty tables
give empty results. ``encode`` reads only the id and the text of its input,
``decode`` passes all columns on, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslode.llm.common import bounded_batches, cut, slices, tidy
from corpuslode.llm.token_counts import _UNIT, SPACE

CHUNK = 32_768
#: Chunks whose matrices one task multiplies; a document has at most as many spans, for a text is below 2 GB.
SPAN = 256
#: Units whose ids a worker keeps, and the characters of the longest of them.
CACHE_UNITS, CACHE_LENGTH = 500_000, 64
SCALE = 1024
#: A character outside the vocabulary scores this much less than the worst piece (fixed value of the library).
UNKNOWN_PENALTY = 10
NONE = -(1 << 60)
BETWEEN = 1  # in place of a score, which is never above zero

_MEET = re.compile(f"[^{SPACE}]{SPACE}")


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: dict[str, int]
    ids: dict[str, int]
    bytes_at: list[int]  # id of each byte's piece
    unknown: int
    longest: int
    trie: dict[str, list]  # by character: the characters that may follow, the score (BETWEEN if this is no piece), the id
    score_at: np.ndarray  # by id; a character in bytes scores at its first one

    def as_unigram(self, path: str) -> bytes:
        """The model file's bytes with the scores used here and the type unigram, for the library."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(open(path, "rb").read())
        for p in m.pieces:
            if p.type == 1:
                p.score = self.scores[p.piece] / SCALE
        m.trainer_spec.model_type = 1
        return m.SerializeToString()


def load(path: str) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    spec = m.normalizer_spec
    if spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not m.trainer_spec.byte_fallback:
        raise ValueError("only models without normalisation, with a space in front and byte fallback")
    normal = [(i, p) for i, p in enumerate(m.pieces) if p.type == 1]
    if any(SPACE in p.piece.lstrip(SPACE) for _, p in normal):
        raise ValueError("a piece of this model crosses a space")
    unigram = m.trainer_spec.model_type == 1
    scores = {p.piece: round(SCALE * (p.score if unigram else -math.log(r + 2))) for r, (_, p) in enumerate(normal)}
    in_bytes = [i for i, p in enumerate(m.pieces) if p.type == 6]
    unknown = min(scores.values()) - UNKNOWN_PENALTY * SCALE
    score_at = np.array([scores.get(p.piece, 0) if p.type == 1 else 0 for p in m.pieces], np.int64)
    score_at[[i for b, i in enumerate(in_bytes) if b & 0xC0 != 0x80]] = unknown
    trie: dict[str, list] = {}
    for i, p in normal:
        follow = trie
        for c in p.piece:
            node = follow.setdefault(c, [{}, BETWEEN, -1])
            follow = node[0]
        node[1:] = scores[p.piece], i
    return Vocabulary([p.piece for p in m.pieces], scores, {p.piece: i for i, p in normal}, in_bytes, unknown, max(map(len, scores)), trie, score_at)


class Path:
    """Best scores by position, and the piece that each was reached by: where it began and its id (-1: one in bytes)."""

    def __init__(self, size: int):
        self.best, self.back, self.ids = [NONE] * (size + 1), [-1] * (size + 1), [-1] * (size + 1)

    def relax(self, v: Vocabulary, text: str, first: int, end: int) -> Path:
        """Extend the scores over pieces that start in [first, end); they may reach beyond it. Of equal ones the piece that starts first stays."""
        best, back, ids, trie, unknown, longest = self.best, self.back, self.ids, v.trie, v.unknown, v.longest
        for i in range(first, end):
            here = best[i]
            if here == NONE:
                continue
            follow, j = trie, i
            for c in text[i : i + longest]:
                node = follow.get(c)
                j += 1
                if node is None:
                    if j == i + 1 and here + unknown > best[j]:
                        best[j], back[j], ids[j] = here + unknown, i, -1
                    break
                follow, s, k = node
                if s == BETWEEN:
                    if j > i + 1:
                        continue
                    s = unknown
                s += here
                if s > best[j]:
                    best[j], back[j], ids[j] = s, i, k
        return self

    def trace(self, v: Vocabulary, text: str, end: int) -> list[int]:
        """Ids back from ``end`` to where the path began."""
        out, back, ids = [], self.back, self.ids
        while (start := back[end]) >= 0:
            if ids[end] >= 0:
                out.append(ids[end])
            else:
                out += [v.bytes_at[b] for b in reversed(text[start:end].encode())]
            end = start
        out.reverse()
        return out

    def began(self, end: int) -> int:
        while self.back[end] >= 0:
            end = self.back[end]
        return end


def encode_whole(v: Vocabulary, text: str) -> list[int]:
    """Ids of a normalised text in one pass."""
    path = Path(len(text))
    path.best[0] = 0
    return path.relax(v, text, 0, len(text)).trace(v, text, len(text))


def decode(v: Vocabulary, ids: list[int], table: list[bytes] | None = None) -> str:
    """The text of ids, without the space that encoding puts in front."""
    table = table or byte_table(v)
    return b"".join(map(table.__getitem__, ids))[1:].decode(errors="replace")


def byte_table(v: Vocabulary) -> list[bytes]:
    table = [p.replace(SPACE, " ").encode() for p in v.pieces]
    for b, i in enumerate(v.bytes_at):
        table[i] = bytes([b])
    return table


class Encoder:
    """Encodes texts of one chunk in a Python worker."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        self.v, self.most = load(path), cache_units
        self.kind, self.code = ("u2", "H") if len(self.v.pieces) <= 1 << 16 else ("u4", "I")
        self.cache: dict[str, bytes] = {}
        self.table = byte_table(self.v)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        text = text.replace(SPACE, " ")
        return self.units(text.split(" ") if text[0] != " " and "  " not in text else [u[1:] for u in _UNIT.findall(" " + text)])

    def units(self, units: list[str]) -> np.ndarray:
        """Ids of units, each without the space that it begins with."""
        cache = self.cache
        if new := set(units).difference(cache):
            if len(cache) + len(new) > self.most:
                cache.clear()
                new = set(units)
            long = {}
            for u in new:
                (cache if len(u) <= CACHE_LENGTH else long)[u] = array(self.code, encode_whole(self.v, SPACE + u.replace(" ", SPACE))).tobytes()
            if long:
                return np.frombuffer(b"".join([cache[u] if len(u) <= CACHE_LENGTH else long[u] for u in units]), self.kind).astype("<u4")
        return np.frombuffer(b"".join(map(cache.__getitem__, units)), self.kind).astype("<u4")

    def whole(self, text: str) -> np.ndarray:
        """Ids of a normalised text of whole units."""
        return self.units([u[1:] for u in _UNIT.findall(text.replace(SPACE, " "))])

    def decode(self, ids: np.ndarray) -> str:
        return decode(self.v, ids.tolist(), self.table)


_workers: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def meeting(text: str, size: int) -> tuple[int, int] | None:
    """Where the first and the last run of spaces behind another character begin, in the first ``size`` characters."""
    m = _MEET.search(text, 0, size)
    if m is None:
        return None
    last = text.rfind(SPACE, 0, size)
    while last > m.end() - 1 and text[last - 1] == SPACE:
        last -= 1
    return m.end() - 1, max(last, m.end() - 1)


def transfer(e: Encoder, text: str, size: int) -> np.ndarray:
    """The matrix of a chunk: ``size`` characters of ``text``, which goes on with what a last piece may need."""
    v = e.v
    k, met = v.longest, meeting(text, size)
    out = np.full((k, k), NONE, np.int64)
    first, rest = size, None
    if met is not None:
        first, last = met
        path = Path(len(text) + k)
        path.best[last] = int(v.score_at[e.whole(text[first:last])].sum())
        rest = np.array(path.relax(v, text, last, size).best[size : size + k], np.int64)
    for s in range(min(k, first + 1)):
        path = Path(len(text) + k if met is None else first + k)
        path.best[s] = 0
        path.relax(v, text, s, first)
        if rest is None:
            out[s] = path.best[size : size + k]
        elif path.best[first] > NONE:
            out[s] = np.where(rest > NONE, rest + path.best[first], NONE)
    return out


def times(vector: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Max-plus product; works for stacked vectors, so for matrices too."""
    both = vector[..., :, None] + matrix
    bad = (vector[..., :, None] <= NONE) | (matrix <= NONE)
    return np.where(bad, NONE, both).max(axis=-2)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The product of adjoining stretches, in a tree."""
    while len(matrices) > 1:
        matrices = [times(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def entries(matrices: list[np.ndarray], entry: np.ndarray) -> list[np.ndarray]:
    """The scores with which each stretch is entered: pairs are multiplied, the pairs entered, and their second ones from their first."""
    if len(matrices) == 1:
        return [entry]
    pairs = [times(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    at = entries(pairs, entry)
    return [at[i // 2] if i % 2 == 0 else times(at[i // 2], matrices[i - 1]) for i in range(len(matrices))]


def after(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The entry state of each exit state of two adjoining stretches, from those of each (-1: none)."""
    return np.where(then < 0, -1, first[then])


def leaves(maps: list[np.ndarray], leave: int) -> list[int]:
    """The exit state of each stretch, from that of the last one, in the tree of ``entries``."""
    if len(maps) == 1:
        return [leave]
    pairs = [after(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    at = leaves(pairs, leave)
    return [int(maps[i + 1][at[i // 2]]) if i % 2 == 0 and i + 1 < len(maps) else at[i // 2] for i in range(len(maps))]


def entered(v: Vocabulary, text: str, end: int, entry: np.ndarray) -> Path:
    """The best paths up to ``end`` for given entry scores."""
    path = Path(len(text) + v.longest)
    path.best[: v.longest] = [int(x) for x in entry]
    return path.relax(v, text, 0, end)


def came_from(e: Encoder, text: str, size: int, entry: np.ndarray) -> list[int]:
    """The entry state of each exit state."""
    k, met = e.v.longest, meeting(text, size)
    if met is not None:
        return [entered(e.v, text, met[0], entry).began(met[0])] * k
    path = entered(e.v, text, size, entry)
    return [path.began(size + s) if path.best[size + s] > NONE else -1 for s in range(k)]


def trace_chunk(e: Encoder, text: str, size: int, entry: np.ndarray, leave: int) -> np.ndarray:
    """Ids of the pieces that begin in a chunk, for its entry scores and its exit state."""
    met = meeting(text, size)
    if met is None:
        return np.array(entered(e.v, text, size, entry).trace(e.v, text, size + leave), "<u4")
    first, last = met
    head = entered(e.v, text, first, entry).trace(e.v, text, first)
    tail = Path(len(text) + e.v.longest)
    tail.best[last] = 0
    tail.relax(e.v, text, last, size)
    return np.concatenate([np.array(head, "<u4"), e.whole(text[first:last]), np.array(tail.trace(e.v, text, size + leave), "<u4")])


def _chunks(docs: DataFrame, longest: int) -> DataFrame:
    """Giant documents, normalised and cut: row (which document), no, size, text with the characters behind it."""
    text = F.concat(F.lit(SPACE), F.translate("text", " ", SPACE))
    starts = F.sequence(F.lit(0), F.length("t") - 1, F.lit(CHUNK))
    d = docs.withColumn("t", text).select("row", "doc_id", F.length("t").alias("all"), "t", F.posexplode(starts).alias("no", "at"))
    return d.select("row", "doc_id", "no", F.least(F.lit(CHUNK), F.col("all") - F.col("at")).alias("size"), F.substring("t", F.col("at") + 1, F.lit(CHUNK + longest)).alias("text"))


def _giants(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, no and ids of each chunk of the giant documents."""
    v = load(path)
    k = v.longest
    kind = dict(docs.dtypes)["doc_id"]
    chunks = cut(_chunks(docs, k), "pieces-chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = encoder(path)
        for b in batches:
            m = [transfer(w, t, n).ravel() for t, n in zip(b.column("text").to_pylist(), b.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("no"), pa.array(m, pa.list_(pa.int64()))], ["row", "no", "m"])

    def square(p: pd.DataFrame) -> list[np.ndarray]:
        return [np.asarray(m).reshape(k, k) for m in p.sort_values("no")["m"]]

    def span_product(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [p["row"].iloc[0]], "no": [p["span"].iloc[0]], "m": [product(square(p)).ravel()]})

    def span_entries(p: pd.DataFrame) -> pd.DataFrame:
        start = np.full(k, NONE, np.int64)
        start[0] = 0
        return pd.DataFrame({"row": p["row"].iloc[0], "span": sorted(p["no"]), "entry": entries(square(p), start)})

    def chunk_entries(p: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": p["row"].iloc[0], "no": sorted(p["no"]), "entry": entries(square(p), np.asarray(at["entry"].iloc[0]))})

    spanned = F.floor(F.col("no") / SPAN).cast("int").alias("span")
    each = cut(chunks.select("row", "no", "size", "text").mapInArrow(matrices, "row long, no int, m array<long>").select("row", "no", "m", spanned), "pieces-matrices")
    spans = each.groupBy("row", "span").applyInPandas(span_product, "row long, no int, m array<long>").groupBy("row").applyInPandas(span_entries, "row long, span int, entry array<long>")
    found = each.groupBy("row", "span").cogroup(spans.groupBy("row", "span")).applyInPandas(chunk_entries, "row long, no int, entry array<long>")
    chunks = cut(chunks.join(found, ["row", "no"]), "pieces-entries")

    def came(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = encoder(path)
        for b in batches:
            maps = [came_from(w, t, n, e) for t, n, e in zip(*(b.column(c).to_pylist() for c in ("text", "size", "entry")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("no"), pa.array(maps, pa.list_(pa.int32()))], ["row", "no", "f"])

    def ordered(p: pd.DataFrame) -> list[np.ndarray]:
        return [np.asarray(f) for f in p.sort_values("no")["f"]]

    def span_map(p: pd.DataFrame) -> pd.DataFrame:
        maps = ordered(p)
        while len(maps) > 1:
            maps = [after(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return pd.DataFrame({"row": [p["row"].iloc[0]], "no": [p["span"].iloc[0]], "f": [maps[0]]})

    def span_leaves(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": p["row"].iloc[0], "span": sorted(p["no"]), "leave": leaves(ordered(p), 0)})

    def chunk_leaves(p: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": p["row"].iloc[0], "no": sorted(p["no"]), "leave": leaves(ordered(p), int(at["leave"].iloc[0]))})

    each = cut(chunks.select("row", "no", "size", "text", "entry").mapInArrow(came, "row long, no int, f array<int>").select("row", "no", "f", spanned), "pieces-maps")
    spans = each.groupBy("row", "span").applyInPandas(span_map, "row long, no int, f array<int>").groupBy("row").applyInPandas(span_leaves, "row long, span int, leave int")
    found = each.groupBy("row", "span").cogroup(spans.groupBy("row", "span")).applyInPandas(chunk_leaves, "row long, no int, leave int")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = encoder(path)
        for b in batches:
            ids = [trace_chunk(w, t, n, e, x).astype(np.int32) for t, n, e, x in zip(*(b.column(c).to_pylist() for c in ("text", "size", "entry", "leave")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("no"), pa.array(ids, pa.list_(pa.int32()))], ["row", "doc_id", "no", "ids"])

    return chunks.join(found, ["row", "no"]).select("row", "doc_id", "no", "size", "text", "entry", "leave").mapInArrow(trace, f"row long, doc_id {kind}, no int, ids array<int>")


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id and ids of each document; with ``digest`` its text and a crc32 of the ids as little-endian 32-bit integers too."""
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    giant = F.coalesce(F.length("text"), F.lit(0)) > CHUNK

    def finish(keys: pa.Array, ids: list[np.ndarray], texts: pa.Array) -> pa.RecordBatch:
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        out = {"doc_id": keys, "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}
        if digest:
            out |= {"text": texts, "ids_crc32": pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())}
        return pa.RecordBatch.from_pydict(out)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_path)
        for b in slices(batches, 512):
            yield finish(b.column("doc_id"), [e(t) for t in b.column("text").to_pylist()], b.column("text"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8):
            ids = [np.concatenate([np.array(p["ids"], np.int64) for p in sorted(parts, key=lambda p: p["no"])]) for parts in b.column("parts").to_pylist()]
            yield finish(b.column("doc_id"), ids, b.column("text"))

    out = f"doc_id {kind}, ids array<int>" + (", text string, ids_crc32 long" if digest else "")
    with tidy(docs.sparkSession):
        large = cut(d.where(giant).withColumn("row", F.monotonically_increasing_id()), "pieces-giants")
        parts = _giants(large, model_path).groupBy("row").agg(F.collect_list(F.struct("no", "ids")).alias("parts"))  # a document's own chunks
        large = cut(large.join(parts, "row").select("doc_id", "text", "parts").mapInArrow(gathered, out), "pieces-large", keep=True)
    return d.where(~giant).mapInArrow(short, out).union(large)


def decode_ids(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids, which are those of ``encode``, in a further column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_path)
        for b in slices(batches, 512):
            ids = b.column(ids_col)
            flat, ends = np.asarray(ids.flatten()), np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_pylist()])
            texts = [e.decode(flat[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield b.append_column(text_col, pc.if_else(ids.is_null(), None, pa.array(texts, pa.string())))

    if text_col in df.columns:
        raise ValueError(f"there is a column {text_col} already")
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text_col, T.StringType())]))
