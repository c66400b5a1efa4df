"""CSV records that go over lines, read by as many tasks as the files have splits.

Whether a line's end ends a record depends on the quotes before it in the whole
file. A first pass takes of each split the parity of its quotes, and whether a
line in it ends at an even or an odd number of them. These few values, a row for
each split, are added up over the splits of a file: that gives each split the
state it begins in, and the split in which the record that reaches into it began.
The second pass cuts each split into records where its task reads it. Only
pieces of records that cross a split's border are shuffled, and put together in
order. Quotes are those of RFC 4180: a field with quotes or line ends is quoted,
quotes in it are doubled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Split(NamedTuple):
    """``inside``: it begins in quotes. ``opener``: where the split begins in which that record began."""

    inside: bool
    opener: int | None


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as bytes, in the order of the file within a split, with their file and where their split begins."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, np.ndarray]]:
    """Stretches of lines of one split: file, start, lines and the quotes up to the end of each."""
    for b in batches:
        if not b.num_rows:
            continue
        file, start = b.column("file").dictionary_encode(), b.column("start").to_numpy(zero_copy_only=False)
        codes = file.indices.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(start) != 0)) + 1
        for a, z in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
            value = b.column("value").slice(a, z - a)
            yield file.dictionary[int(codes[a])].as_py(), int(start[a]), value, np.cumsum(pc.count_substring(value, b'"').to_numpy(zero_copy_only=False))


def survey(rows: DataFrame) -> DataFrame:
    """Of each split: file, start, odd (number of quotes), even_end and odd_end (whether a line ends behind such a number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[bool]] = {}
        for file, start, _, quotes in _segments(batches):
            known = found.setdefault((file, start), [False, False, False])
            state = (quotes + known[0]) % 2
            found[file, start] = [bool(state[-1]), known[1] or bool((state == 0).any()), known[2] or bool((state == 1).any())]
        if found:
            table = [(*k, *v) for k, v in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*table, strict=True)], ["file", "start", "odd", "even_end", "odd_end"])

    return rows.mapInArrow(run, "file string, start long, odd boolean, even_end boolean, odd_end boolean")


def begun(surveyed: DataFrame) -> dict[tuple[str, int], Split]:
    """The state of each split; a row for each split comes to the driver, as the scan's own plan has."""
    found: dict[tuple[str, int], Split] = {}
    last, inside, opener = None, False, None
    for r in sorted(surveyed.collect(), key=lambda r: (r["file"], r["start"])):
        if r["file"] != last:
            last, inside, opener = r["file"], False, None
        found[r["file"], r["start"]] = Split(inside, opener)
        ended = r["odd_end"] if inside else True
        inside ^= r["odd"]
        opener = (r["start"] if ended else opener) if inside else None
    return found


def _pieces(rows: DataFrame, states: dict[tuple[str, int], Split], encoding: str) -> DataFrame:
    """Whole records (opener null), and pieces of those that cross a border; without the first record of a file."""
    shared = rows.sparkSession.sparkContext.broadcast(states)

    def decoded(texts: pa.Array) -> pa.Array:
        if encoding.lower() in ("utf-8", "utf-8-sig"):
            try:
                return texts.cast(pa.string())
            except pa.ArrowInvalid:
                pass
        return pa.array([t.decode(encoding, "replace") for t in texts.to_pylist()], pa.string())

    def piece(texts: pa.Array, file: str | None = None, opener: int | None = None, at: int | None = None) -> pa.RecordBatch:
        n = len(texts)
        kinds = (file, pa.string()), (opener, pa.int64()), (at, pa.int64())
        return pa.RecordBatch.from_arrays([decoded(texts), *(pa.array([v] * n, k) for v, k in kinds)], ["text", "file", "opener", "at"])

    def joined(parts: list[pa.Array], offsets: np.ndarray) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.concat_arrays(parts)), b"\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, header, first = None, Split(False, None), False, True
        #: Lines of a record that has not ended, and the parity of the split's quotes so far.
        pending: list[pa.Array] = []
        odd = 0

        def rest() -> Iterator[pa.RecordBatch]:
            if pending:
                if header:
                    raise ValueError("a header does not end in its file's first split")
                whole = pa.concat_arrays(pending)
                yield piece(joined([whole], np.array([0, len(whole)])), now[0], state.opener if first and state.inside else now[1], now[1])

        for file, start, value, quotes in _segments(batches):
            if now != (file, start):
                yield from rest()
                now, pending, odd, first, header = (file, start), [], 0, True, start == 0
                state = shared.value[now]
            parity = (quotes + odd + state.inside) % 2
            odd = int(quotes[-1] + odd) % 2
            ends = np.flatnonzero(parity == 0) + 1
            held = sum(map(len, pending))
            if not len(ends):
                pending.append(value)
                continue
            found = joined([*pending, value], np.r_[0, ends + held])
            pending = [value.slice(int(ends[-1]))] if ends[-1] < len(value) else []
            if first and state.inside:
                yield piece(found.slice(0, 1), file, state.opener, start)
                found = found.slice(1)
            elif header:
                found, header = found.slice(1), False
            first = False
            if len(found):
                yield piece(found)
        yield from rest()

    return rows.mapInArrow(run, "text string, file string, opener long, at long")


def read_records(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """text: each record of CSV files with a header, line ends in it as they are. Records of white space only are left out."""
    rows = lines(spark, path)
    states = begun(survey(rows))
    pieces = _pieces(rows, states, encoding)
    found = pieces.where("opener IS NULL").select("text")
    if any(s.inside for s in states.values()):
        parts = pieces.where("opener IS NOT NULL").groupBy("file", "opener").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"))
        found = found.unionByName(parts.select(F.array_join(F.col("p.text"), "\n").alias("text")))
    return found.select(F.regexp_replace("text", r"\r\z", "").alias("text")).where(F.trim("text") != "")
