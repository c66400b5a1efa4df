"""Runs of periodic words in texts: maximal stretches that repeat with a period, by internal pattern matching.

A run is a stretch of words with smallest period q and at least
``max(least, 2 q)`` words that no neighbouring word extends. The words of a
group of texts become one array of codes. A code stands for a word in one text,
and each text ends with a code of its own, so nothing matches across texts.

Prefix doubling ranks the substrings of 1, 2, 4, ... words, until all are
different; the last ranks are the suffix array. Each dyadic block (m = 2^k words
at a multiple of m) is a range of it, and a wavelet matrix over it answers for
many blocks at once where a block occurs next behind a place (range successor:
the count of smaller places in a range, then the place of that order). A run of
length L and period q holds a block of each m with 2 m - 1 <= L - q, and that
block again q words on, so level k asks for the periods whose shortest run
holds such a block. The window of these places is cut into parts of m / 2
places. Occurrences in a part are an arithmetic progression, whose difference d
is the block's own period. Of more than two, only those can begin a run that
carry the end, or the begin, of the d-periodic stretch around the block to that
of the stretch around the occurrence; all of them if these two stretches meet.
Candidates are extended on both sides by the ranks. Blocks that occur once are
never asked for.

Work is O(n log^2 n) for n words, memory n words of each level that has repeats;
levels end when no substring of that length occurs twice in a text. A text is
in one task, as a row is; groups of texts are bounded by ``GROUP_WORDS``.

Null and empty text, and text of white space, have no words and no runs, and
collapse to the empty text. Repeated rows are found alike. Null ids are kept.
Other columns are not read, so their names may clash. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.llm.common import WORD, bounded_batches

LEAST = 12
#: Words of the texts that are worked on together; a longer text is a group of its own.
GROUP_WORDS = 200_000


def ranked(codes: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ... the rank of the substring of 2^k codes at each place, equal ones alike; the last ranks are all different.

    A rank is the number of smaller substrings. Codes that occur once are ends of texts.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    fresh = np.r_[True, codes[order][1:] != codes[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    levels, size = [rank], 1
    active = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(active):
        # an active substring holds no end of a text, so the place behind it exists
        second = rank[active + size]
        order = np.lexsort((second, rank[active]))
        active, second = active[order], second[order]
        first = rank[active]
        group = np.r_[True, first[1:] != first[:-1]]
        fresh = group | np.r_[True, second[1:] != second[:-1]]
        place = np.arange(len(active))
        began, own = place[group][np.cumsum(group) - 1], place[fresh][np.cumsum(fresh) - 1]
        rank = rank.copy()
        rank[active] = first + own - began
        levels.append(rank)
        sizes = np.diff(np.r_[np.flatnonzero(fresh), len(active)])
        active, size = active[sizes[np.cumsum(fresh) - 1] > 1], 2 * size
    return levels


class WaveletMatrix:
    """Order statistics of ranges of an array of different whole numbers, for many ranges at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            zeros = np.r_[0, np.cumsum(~one)]
            self.levels.append((b, zeros, zeros[-1]))
            values = np.r_[values[~one], values[one]]

    def smaller(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of [low, high) are below x."""
        found = np.zeros(len(low), np.int64)
        for b, zeros, n in self.levels:
            one, a, c = (x >> b & 1).astype(bool), zeros[low], zeros[high]
            found += np.where(one, c - a, 0)
            low, high = np.where(one, n + low - a, a), np.where(one, n + high - c, c)
        return found

    def nth(self, low: np.ndarray, high: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The value of [low, high) that i others are below."""
        found = np.zeros(len(low), np.int64)
        for b, zeros, n in self.levels:
            a, c = zeros[low], zeros[high]
            one = i >= c - a
            i = np.where(one, i - (c - a), i)
            found |= one.astype(np.int64) << b
            low, high = np.where(one, n + low - a, a), np.where(one, n + high - c, c)
        return found


def ahead(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many codes from a and from b on are equal (a < b)."""
    found = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        found += (levels[k][a + found] == levels[k][b + found]).astype(np.int64) << k
    return found


def behind(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many codes before a and before b are equal (a < b)."""
    found = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        x = a - found - (1 << k)
        found += ((x >= 0) & (levels[k][np.maximum(x, 0)] == levels[k][np.maximum(b - found - (1 << k), 0)])).astype(np.int64) << k
    return found


def asked(least: int, n: int) -> dict[int, tuple[int, int]]:
    """For each level the smallest and the largest period that its blocks are asked for."""
    found: dict[int, tuple[int, int]] = {}
    q = 1
    while q <= n // 2:
        k = (max(least, 2 * q) - q + 1).bit_length() - 2
        # behind half the least length a level's periods are the next ones up to twice as many
        last = q if 2 * q < least + 2 else min((4 << k) - 2, n // 2)
        low, high = found.get(k, (q, last))
        found[k] = min(low, q), max(high, last)
        q = last + 1
    return found


def _candidates(levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods that may begin a run."""
    n, places, periods = len(levels[0]), [], []
    if len(levels) == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows = asked(least, n)
    shortest = min(windows, default=0)
    # places that are alone at the shortest block are in no range that is asked for
    kept = np.bincount(levels[min(shortest, len(levels) - 1)], minlength=n) > 1
    kept = kept[levels[min(shortest, len(levels) - 1)]]
    suffixes = np.empty(n, np.int64)
    suffixes[levels[-1]] = np.arange(n)
    kept = kept[suffixes]
    before = np.r_[0, np.cumsum(kept)]
    tree = WaveletMatrix(suffixes[kept], n.bit_length())
    for k, (least_q, most_q) in windows.items():
        if k >= len(levels) - 1:
            continue
        m, rank = 1 << k, levels[k]
        blocks = np.arange(0, n, m)
        size = np.bincount(rank, minlength=n)[rank[blocks]]
        blocks, size = blocks[size > 1], size[size > 1]
        if not len(blocks):
            continue
        low, high = before[rank[blocks]], before[rank[blocks] + size]
        width = max(1, m // 2)
        edges = np.append(np.arange(least_q, most_q + 1, width), most_q + 1)
        counts = [tree.smaller(low, high, np.minimum(blocks + e, n)) for e in edges]
        for c, after in zip(counts[:-1], counts[1:], strict=True):
            some = np.flatnonzero(after > c)
            if not len(some):
                continue
            i, number = blocks[some], (after - c)[some]
            first = tree.nth(low[some], high[some], c[some])
            last = tree.nth(low[some], high[some], after[some] - 1)
            places += [i, i]
            periods += [first - i, last - i]
            many = np.flatnonzero(number > 2)
            if not len(many):
                continue
            i, first, last, number = i[many], first[many], last[many], number[many]
            d = (last - first) // (number - 1)
            own_begin, own_end = i - behind(levels, i, i + d), i + d + ahead(levels, i, i + d)
            begin, end = first - behind(levels, first, first + d), first + d + ahead(levels, first, first + d)
            apart = begin != own_begin
            for q in (end - own_end, begin - own_begin):
                ok = apart & (q >= first - i) & (q <= last - i) & ((q - first + i) % d == 0)
                places.append(i[ok])
                periods.append(q[ok])
            meet = np.flatnonzero(apart & (own_end >= begin))
            if len(meet):
                of = np.repeat(meet, number[meet])
                step = np.arange(len(of)) - np.repeat(np.cumsum(number[meet]) - number[meet], number[meet])
                places.append(i[of])
                periods.append((first - i)[of] + step * d[of])
    return np.concatenate(places or [np.zeros(0, np.int64)]), np.concatenate(periods or [np.zeros(0, np.int64)])


def runs(codes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of each run, by start, then period."""
    levels = ranked(codes)
    i, q = _candidates(levels, least)
    both = np.unique(i * len(codes) + q)
    i, q = both // len(codes), both % len(codes)
    start, end = i - behind(levels, i, i + q), i + q + ahead(levels, i, i + q)
    ok = end - start >= np.maximum(least, 2 * q)
    start, end, q = start[ok], end[ok], q[ok]
    # a stretch found with a multiple of its period is found with the period too
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def groups(sizes: np.ndarray, most: int = GROUP_WORDS) -> Iterator[tuple[int, int]]:
    """Parts of a batch of about ``most`` words."""
    a = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if len(sizes):
        yield a, len(sizes)


def _found(ids: pa.Array, words: pa.ListArray, least: int) -> pa.RecordBatch:
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten()
    known = flat.dictionary_encode()
    codes = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    texts, v = len(sizes), max(1, len(known.dictionary))
    # words of text t are in t * v ..., its end is a code behind all of them; a place moves on by the ends before it
    of = np.repeat(np.arange(texts), sizes)
    all_codes = np.empty(len(codes) + texts, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    all_codes[np.arange(len(codes)) + of] = of * v + codes
    all_codes[ends] = texts * v + np.arange(texts)
    start, end, q = runs(all_codes, least) if texts else (np.zeros(0, np.int64),) * 3
    text = np.searchsorted(ends, start)
    change = np.zeros(len(all_codes) + 1, np.int64)
    np.add.at(change, start + q, 1)
    np.add.at(change, end, -1)
    kept = np.delete(np.cumsum(change[:-1]) == 0, ends)
    left = flat.filter(pa.array(kept))
    offsets = np.r_[0, np.cumsum(np.bincount(of[kept], minlength=texts))]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), left), " ")
    struct = pa.StructArray.from_arrays([pa.array(x) for x in (start - (np.r_[0, ends + 1])[text], end - start, q)], ["start", "length", "period"])
    places = np.r_[0, np.cumsum(np.bincount(text, minlength=texts))].astype(np.int32)
    return pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.ListArray.from_arrays(pa.array(places), struct), collapsed], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, words: str | None = None, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of each row.

    ``collapsed`` is the text's words joined by a space, without those that
    stand in a run behind its first period. ``words``: a column of words to
    take instead of the text's.
    """
    bounded_batches(docs.sparkSession)
    taken = F.col(f"`{words}`") if words else F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(WORD), F.lit(0))
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(taken, F.array().cast("array<string>")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.list_value_length(b.column("words")).to_numpy(zero_copy_only=False)
            for a, z in groups(sizes):
                part = b.slice(a, z - a)
                yield _found(part.column("doc_id"), part.column("words"), least)

    kind = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
