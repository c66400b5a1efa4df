"""Tokens of two tokenizers aligned by their bytes, and how often two ids end together in the whole corpus.

A (a byte-level BPE file of tokenizers) encodes a space and the text, B (a
SentencePiece file that puts a space in front) the text: both make the same
bytes. The ends of A's and B's tokens are two ascending lists of byte offsets.
The shorter list drives: each of its ends is looked for in the longer one by
steps of 1, 2, 4, ... from where its part of the text begins, then by bisection
between the last two places, many ends at once. The common ends cut both token lists into groups; the
differences between the places of neighbouring common ends are the ranges of
tokens that overlap. The last tokens of a group end together: a link.

A text is cut in front of runs of spaces behind a character that is no white
space. No token of either side crosses such a place, and both sides end there,
so groups never do: each different part is encoded and aligned once and kept in
a worker's cache, bounded by its characters.

The links of a document are counted by pair in its own row, then by pair in the
corpus (a shuffle of partial sums), and the highest count of each B id is the
maximum over its pairs. Counts go back to the documents without a shuffle where
the pairs are at most ``BROADCAST_PAIRS`` (24 bytes each), else by a join on the
pair, which adaptive execution can split.

Null and empty texts, and texts whose tokens give other bytes (those that hold
U+2581, which B turns into a space), have no tokens: zeros and an empty
``groups``. Strings of special tokens in a text are plain text. Repeated rows
and repeated or null ids are documents of their own, and each counts. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.llm.common import bounded_batches, cut, slices

#: Characters of the parts that a Python worker keeps; then it starts anew.
CACHE_CHARS = 6_000_000
#: Parts encoded in one call.
CALL_PARTS = 4096
#: Pairs of ids up to which their counts are broadcast (96 MB).
BROADCAST_PAIRS = 4_000_000
#: A pair is A's id times this, and B's id.
PAIR = 1 << 32

_CUT = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"[^\S ] |  ")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The place of the first value of ``long`` that is not below each of ``short``, looked for from ``start`` on; all at once."""
    n, reach = len(long), np.ones(len(short), np.int64)
    on = np.arange(len(short))
    while len(on):
        p = start[on] + reach[on]
        on = on[(p < n) & (long[np.minimum(p, n - 1)] < short[on])]
        reach[on] *= 2
    # the place is in [start + reach / 2, start + reach]
    low, high = start + reach // 2, np.minimum(start + reach, n)
    on = np.flatnonzero(low < high)
    while len(on):
        mid = (low[on] + high[on]) // 2
        below = long[mid] < short[on]
        low[on], high[on] = np.where(below, mid + 1, low[on]), np.where(below, high[on], mid)
        on = on[low[on] < high[on]]
    return low


def common_ends(a: np.ndarray, b: np.ndarray, a_starts: np.ndarray | None = None, b_starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the values that both ascending lists hold.

    ``a_starts``: for each value of b a place of a that its own is not before,
    at the parts' beginnings; ``b_starts`` likewise. The shorter list drives.
    """
    if len(a) > len(b):
        y, x = common_ends(b, a, b_starts, a_starts)
        return x, y
    at = gallop(a, b, np.zeros(len(a), np.int64) if b_starts is None else b_starts)
    hit = np.flatnonzero(at < len(b))
    hit = hit[b[at[hit]] == a[hit]]
    return hit, at[hit]


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Rows:
    """Rows of whole numbers in one array that grows by doubling."""

    def __init__(self, width: int):
        self.n, self._all = 0, np.empty((1024, width), np.int64)

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self._all):
            self._all = np.concatenate([self._all[: self.n], np.empty((max(self.n, len(rows)) + 1024, self._all.shape[1]), np.int64)])
        self._all[self.n : self.n + len(rows)] = rows
        self.n += len(rows)

    @property
    def rows(self) -> np.ndarray:
        return self._all[: self.n]


class Aligner:
    """Parts of texts, encoded and aligned, in one Python worker."""

    def __init__(self, a_path: str, b_path: str, cache_chars: int = CACHE_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        value = byte_values()
        self.a_bytes: dict[int, bytes] = {i: bytes(value[c] for c in t) if all(c in value for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes.fromhex(m[1]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, t in self.a_bytes.items():
            self.a_sizes[i] = len(t)
        self.b_sizes = np.array(list(map(len, self.b_bytes)))
        self.most = cache_chars
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.groups: list[str] = []
        #: Of each part: A's tokens, B's tokens, groups, whether both sides give its bytes, and where its links begin.
        self.known = Rows(5)
        self.links = Rows(1)
        self.held = 0

    @staticmethod
    def parts(text: str) -> list[str]:
        """The parts of a space and the text, each with the spaces it begins with."""
        text = " " + text
        return _CUT.split(text) if _ODD.search(text) else [" " + p for p in text[1:].split(" ")]

    def learn(self, parts: list[str]) -> None:
        for i in range(0, len(parts), CALL_PARTS):
            some = parts[i : i + CALL_PARTS]
            a = [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]
            # B puts no space in front of an empty text: the one that ends a text is a piece of its own
            b = [[self.b.piece_to_id("▁")] if p == " " else ids for p, ids in zip(some, self.b.encode([p[1:] for p in some], num_threads=1), strict=True)]
            self._keep(some, a, b)

    def _keep(self, parts: list[str], a: list[list[int]], b: list[list[int]]) -> None:
        sizes_a, sizes_b = (np.fromiter(map(len, x), np.int64, len(parts)) for x in (a, b))
        ids_a, ids_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        same = self._same(parts, a, b, ids_a, ids_b)
        flat_a, flat_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        # parts whose bytes differ stand on bytes of their own, where nothing ends together
        ends_a, ends_b = self.a_sizes[flat_a], self.b_sizes[flat_b]
        first_a, first_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
        part_a, part_b = np.repeat(np.arange(len(parts)), sizes_a), np.repeat(np.arange(len(parts)), sizes_b)
        ends_a, ends_b = np.cumsum(np.where(same[part_a], ends_a, 0)), np.cumsum(np.where(same[part_b], ends_b, 0))
        keep_a, keep_b = np.flatnonzero(same[part_a]), np.flatnonzero(same[part_b])
        before_a, before_b = np.cumsum(np.where(same, sizes_a, 0)) - np.where(same, sizes_a, 0), np.cumsum(np.where(same, sizes_b, 0)) - np.where(same, sizes_b, 0)
        x, y = common_ends(ends_a[keep_a], ends_b[keep_b], before_a[part_b[keep_b]], before_b[part_a[keep_a]])
        x, y = keep_a[x], keep_b[y]
        of = part_a[x]
        number = np.bincount(of, minlength=len(parts))
        # a group begins behind the one before it, or with its part
        new = np.r_[True, of[1:] != of[:-1]][: len(of)]
        from_a, from_b = (np.where(new, first[of], np.r_[0, at[:-1] + 1][: len(at)]) for first, at in ((first_a, x), (first_b, y)))
        text_a, text_b = list(map(str, ids_a)), list(map(str, ids_b))
        groups = [f"{','.join(text_a[i:m])}|{','.join(text_b[j:n])}" for i, m, j, n in zip(from_a.tolist(), (x + 1).tolist(), from_b.tolist(), (y + 1).tolist(), strict=True)]
        last = np.cumsum(number).tolist()
        self.groups += [groups[j - 1] if n == 1 else ";".join(groups[j - n : j]) for n, j in zip(number.tolist(), last, strict=True)]
        at = len(self.places)
        self.places.update(zip(parts, range(at, at + len(parts)), strict=True))
        self.known.add(np.stack([sizes_a, sizes_b, number, same, self.links.n + np.cumsum(number) - number], axis=1))
        self.links.add((flat_a[x] * PAIR + flat_b[y])[:, None])
        self.held += sum(map(len, parts))

    def _same(self, parts: list[str], a: list[list[int]], b: list[list[int]], ids_a: list[int], ids_b: list[int]) -> np.ndarray:
        """Of each part whether both sides give its bytes."""
        whole = "".join(parts).encode()
        if b"".join(map(self.a_bytes.__getitem__, ids_a)) == whole == b"".join(map(self.b_bytes.__getitem__, ids_b)):
            return np.ones(len(parts), bool)
        return np.array([b"".join(map(self.a_bytes.__getitem__, x)) == p.encode() == b"".join(map(self.b_bytes.__getitem__, y)) for p, x, y in zip(parts, a, b, strict=True)], bool)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[np.ndarray]]:
        """Of each text A's tokens, B's tokens and groups; its groups and the pairs of its links."""
        parts = [self.parts(t) if t else [] for t in texts]
        if self.held > self.most:
            self.clear()
        places = self.places
        self.learn([p for p in set().union(*parts) if p not in places])
        sizes, groups, links = np.zeros((len(texts), 3), np.int64), [], []
        known, flat = self.known.rows, self.links.rows[:, 0]
        for i, ps in enumerate(parts):
            at = list(map(places.__getitem__, ps))
            mine = known[np.array(at, np.int64)]
            if at and mine[:, 3].all():
                sizes[i] = mine[:, :3].sum(axis=0)
                groups.append(";".join(map(self.groups.__getitem__, at)))
                n = mine[:, 2]
                links.append(flat[np.arange(n.sum()) + np.repeat(mine[:, 4] - np.cumsum(n) + n, n)])
            else:
                groups.append("")
                links.append(flat[:0])
        return sizes, groups, links


_workers: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    key = (a_path, b_path)
    if key not in _workers:
        _workers[key] = Aligner(*key)
    return _workers[key]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), pairs (A's id * 2^32 + B's id) and times of each row.

    ``pairs`` are the different pairs of the document's links, ascending, and ``times`` how often it has them. Both files must be readable on each executor.
    """
    bounded_batches(docs.sparkSession)
    d = docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS string) AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = aligner(a_path, b_path)
        for b in slices(batches):
            sizes, groups, links = found.batch(b.column("text").to_pylist())
            counted = [np.unique(x, return_counts=True) for x in links]
            offsets = pa.array(np.cumsum([0, *(len(p) for p, _ in counted)]).astype(np.int32))
            pairs, times = (pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int64))) for x in zip(*counted, strict=True))
            long = [pa.array(x, pa.int64()) for x in (*sizes.T, [len(x) for x in links])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *long, pa.array(groups), pairs, times], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    kind = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, b_id, n (links of the whole corpus) and best (whether no other pair of the B id has more)."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    each = each.withColumn("b_id", F.col("pair") % PAIR)
    most = each.groupBy("b_id").agg(F.max("n").alias("most"))
    return each.join(most, "b_id").select("pair", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` with n_best and count_sum in place of pairs and times. Both tables are read more than once."""
    if counts.count() <= broadcast_pairs:
        return _looked_up(aligned, counts)
    row = aligned.withColumn("row", F.monotonically_increasing_id())
    links = row.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return row.drop("pairs", "times").join(sums, "row", "left").drop("row").na.fill(0, ["n_best", "count_sum"])


def _looked_up(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The join in the row, with the counts broadcast as sorted arrays."""
    table = counts.select("pair", "n", "best").toArrow().sort_by("pair")
    shared = aligned.sparkSession.sparkContext.broadcast([table[c].to_numpy() for c in ("pair", "n", "best")])
    d = aligned.select(*[c for c in aligned.columns if c not in ("pairs", "times")], "pairs", "times")
    names = d.columns[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for b in batches:
            pairs, times = b.column("pairs"), b.column("times").flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(b.num_rows), pc.list_value_length(pairs).to_numpy(zero_copy_only=False))
            at = np.searchsorted(pair, pairs.flatten().to_numpy(zero_copy_only=False))
            sums = []
            for x in (times * best[at], times * n[at]) if len(at) else (np.zeros(0, np.int64),) * 2:
                total = np.zeros(b.num_rows, np.int64)
                np.add.at(total, of, x.astype(np.int64))
                sums.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *sums], [*names, "n_best", "count_sum"])

    kinds = dict(d.dtypes)
    return d.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", n_best long, count_sum long")


def aligned_with_counts(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``align`` and ``with_counts``; the aligned table is written once to shared scratch. ``digest``: groups_sha256 in place of groups, '' without tokens."""
    found = align(docs, a_path, b_path, id_col, text_col)
    if digest:
        found = found.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).withColumnRenamed("groups", "groups_sha256")
    found = cut(found, "aligned")
    return with_counts(found, cut(pair_counts(found), "pair-counts"))
