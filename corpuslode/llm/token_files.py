"""Token ids of documents in binary packs, with a shared zstandard dictionary.

A store is a folder with two Parquet tables. ``dictionary`` holds one row: the
dictionary's hash and bytes. ``packs`` holds one row per pack: the range
partition and place it stands at, the ids of its documents in ascending order,
and its bytes: a header (magic, bytes per id, dictionary hash, number of
documents), the offsets of the documents' frames, then one zstandard frame per
document. A document is the little-endian array of its ids, each of 2 bytes
where the vocabulary allows it, else 4. A short document is read by its pack's
header and one frame. Writing goes through Spark's writers, so a lost or
repeated task leaves no trace, and any file system will do.

The dictionary is trained on the id arrays of at most ``SAMPLE_DOCS``
documents of at most ``SAMPLE_CHARS`` characters; it changes sizes, never ids.

Encoding cuts a text at single spaces, before which no token can cross, and
keeps the ids of the parts it has met; a text with white space of other kinds
or in runs goes to the library whole. Null and empty text hold the end id
alone. Documents with equal ids are all kept, in the order they come in. An
empty table gives an empty store.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslode.llm.common import bounded_batches, share

MAGIC = b"CLTOKEN1"
PACK_BYTES = 4_000_000
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 20_000
DICTIONARY_BYTES = 112_640
LEVEL = 1
CACHE_PARTS = 1_000_000

#: White space that is neither a space nor a line's end, as either library has it.
_ODD_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_RUN = re.compile(r"\s (?!\S)")
#: Characters of a part's end that are tokens of their own behind letters.
_ENDS = string.punctuation


def _odd(text: str) -> bool:
    """Whether white space stands in a text such that cutting it at spaces could change tokens."""
    return any(c in text for c in _ODD_BLANKS) or (("  " in text or "\n " in text) and _RUN.search(text) is not None)


class Encoder:
    """Ids of texts as bytes, in one Python worker."""

    def __init__(self, path: str, end_id: int, cache_parts: int = CACHE_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.width = 2 if max(self.model.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.end = self.bytes([end_id])
        self.most = cache_parts
        self.cache: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        # tokens that begin with a space: a part's first token does, and no other one of it
        vocabulary = self.model.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True

    def bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: list[str]) -> None:
        """Encode parts, each with the space in front, and keep their ids.

        Punctuation behind letters is a token run of its own, so a part of both
        is put together from its two sides. The others go in one text, cut
        again where a token begins with a space; a part of white space only, or
        that begins with a line's end, would be merged with its neighbour there
        and goes alone.
        """
        cache, firsts, plain, alone, joined = self.cache, self.firsts, {}, {}, []
        for p in parts:
            stem = p.rstrip(_ENDS)
            if stem != p and stem.isalpha() and (stem.isascii() or max(stem) < "ɐ"):  # letters in all versions of Unicode
                joined.append((p, stem, p[len(stem) :]))
                if stem not in cache:
                    plain[stem] = None
            elif p and p[0] != "\n":
                plain[p] = None
            else:
                alone[p] = None
        if plain:
            ids = np.array(self.ids([" " + " ".join(plain)])[0])
            at = np.flatnonzero(self.begins[ids])
            if len(at) == len(plain) and at[0] == 0:
                data, ends = ids.astype(self.kind).tobytes(), [*(at * self.width).tolist(), len(ids) * self.width]
                cache.update(zip(plain, [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], strict=True))
            else:
                alone |= plain
        if alone:
            cache.update(zip(alone, map(self.bytes, self.ids([" " + p for p in alone])), strict=True))
        for p, stem, end in joined:
            cache[p] = cache[stem] + (firsts.get(end) or self.first(end))

    def __call__(self, text: str | None) -> bytes:
        """The ids of the text and the end id."""
        if not text:
            return self.end
        if _odd(text):
            return self.bytes(self.ids([text])[0]) + self.end
        parts, cache = text.split(" "), self.cache
        head = self.first(parts[0])
        found = list(map(cache.get, parts))
        found[0] = head
        if None in found:
            new = [i for i, f in enumerate(found) if f is None]
            if len(cache) + len(new) > self.most:
                # those of this text are held in ``found``
                cache.clear()
            self.learn([parts[i] for i in new])
            for i in new:
                found[i] = cache[parts[i]]
        found.append(self.end)
        return b"".join(found)

    def first(self, part: str) -> bytes:
        """The ids of the first part, which has no space in front."""
        found = self.firsts.get(part)
        if found is None:
            if len(self.firsts) > self.most // 10:
                self.firsts.clear()
            found = self.firsts[part] = self.bytes(self.ids([part])[0]) if part else b""
        return found


_workers: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    key = (path, end_id)
    if key not in _workers:
        _workers[key] = Encoder(path, end_id)
    return _workers[key]


def _train(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; their own bytes where they are too few to train one, and none without samples."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _hash(dictionary: bytes) -> int:
    return xxhash.xxh64_intdigest(dictionary)


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def pack(width: int, dictionary: int, frames: list[bytes]) -> bytes:
    offsets = np.cumsum([0, *map(len, frames)]).astype("<u8")
    return b"".join([MAGIC, struct.pack("<BQI", width, dictionary, len(frames)), offsets.tobytes(), *frames])


class Pack:
    """A pack's header, and its documents one by one."""

    def __init__(self, data: bytes, dictionary: bytes):
        self.data = data
        if data[:8] != MAGIC:
            raise ValueError("this is no pack of token ids")
        self.width, found, self.n = struct.unpack_from("<BQI", data, 8)
        if found != _hash(dictionary):
            raise ValueError("the pack was written with another dictionary")
        self.offsets = np.frombuffer(data, "<u8", self.n + 1, 21)
        self.base = 21 + 8 * (self.n + 1)
        self.zstd = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, i: int) -> np.ndarray:
        a, b = self.base + int(self.offsets[i]), self.base + int(self.offsets[i + 1])
        return np.frombuffer(self.zstd.decompress(self.data[a:b]), f"<u{self.width}").astype("<u4")


def write(docs: DataFrame, path: str, model_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each document, append ``end_id`` and write the store at ``path``, in ascending order of ids."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    d = docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS string) AS text")
    kind = dict(d.dtypes)["doc_id"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model_path, end_id)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode(t) for t in b.column("text").to_pylist()], pa.binary())], ["ids"])

    sample = share(d.where(F.length("text") <= SAMPLE_CHARS), SAMPLE_DOCS, F.col("doc_id"), F.col("text")).select("text").limit(2 * SAMPLE_DOCS).mapInArrow(encoded, "ids binary")
    dictionary = _train(sorted(bytes(r["ids"]) for r in sample.collect()))  # bounded
    spark.createDataFrame([(f"{_hash(dictionary):016x}", bytearray(dictionary))], "hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(model_path, end_id), TaskContext.get().partitionId()
        zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_content_size=True)
        keys, frames, size, seq, start, n = [], [], 0, 0, 0, 0

        def row() -> pa.RecordBatch:
            data = pack(encode.width, _hash(dictionary), frames)
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "start", "n_tokens", "doc_ids", "data"])

        for b in batches:
            for key, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                ids = encode(text.as_py())
                frame = zstd.compress(ids)
                keys.append(key)
                frames.append(frame)
                size += len(frame)
                n += len(ids) // encode.width
                if size >= PACK_BYTES:
                    keys = pa.array([k.as_py() for k in keys], b.schema.field("doc_id").type)
                    yield row()
                    keys, frames, size, seq, start, n = [], [], 0, seq + 1, start + n, 0
            key_type = b.schema.field("doc_id").type
        if frames:
            keys = pa.array([k.as_py() for k in keys], key_type)
            yield row()

    out = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(packed, f"part int, seq int, start long, n_tokens long, doc_ids array<{kind}>, data binary")
    out.write.option("compression", "uncompressed").parquet(f"{path}/packs")


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    return spark.read.parquet(f"{path}/packs"), bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Each document of the store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, its ids."""
    packs, dictionary = _stored(spark, path)
    kind = dict(packs.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    # a row per range partition
    totals, base = [], 0
    for r in sorted(packs.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        totals.append((r["part"], base))
        base += r["n"]
    before = F.broadcast(spark.createDataFrame(totals, "part int, base long"))
    placed = packs.join(before, "part").select((F.col("base") + F.col("start")).alias("start"), "doc_ids", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, keys, data in zip(b.column("start").to_pylist(), b.column("doc_ids"), b.column("data"), strict=True):
                p, keys = Pack(data.as_py(), dictionary), keys.values
                for low in range(0, p.n, 1024):
                    ids = [p.ids(i) for i in range(low, min(low + 1024, p.n))]
                    sizes = np.array([len(x) for x in ids], np.int64)
                    columns = [keys[low : low + len(ids)], pa.array(start + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    start += int(sizes.sum())
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    more = ", ids array<long>" if with_ids else ""
    return placed.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long{more}")


def fetch(spark: SparkSession, path: str, doc_id) -> list[list[int]]:
    """Ids of the documents with this id: their packs' headers and frames only are decoded."""
    packs, dictionary = _stored(spark, path)
    out = []
    for r in packs.where(F.array_contains("doc_ids", F.lit(doc_id))).select("doc_ids", "data").collect():
        p = Pack(bytes(r["data"]), dictionary)
        out += [p.ids(i).tolist() for i, k in enumerate(r["doc_ids"]) if k == doc_id]
    return out
