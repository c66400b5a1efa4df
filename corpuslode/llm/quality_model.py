"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few ratios of character and word counts. Each feature is
cut into bins at its quantiles. Boosting goes round the features again and
again: on the residuals it grows a tree of at most three leaves on one
feature, and adds its leaf values to that feature's lookup table. Then the
feature pairs with the largest gain get tables of two dimensions in the same
way, from trees with one cut on either feature. A score is the sum of the
table entries of a text's bins, through the logistic function: whole batches
are scored by indexed additions.

The model is fitted on about ``MAX_ROWS`` labelled rows (a share by a hash of
the id), of which the feature rows are gathered on the driver in the order of
their ids; where ids repeat, at most twice as many labels and four times as
many rows. Its size does not depend on the input. Null text counts as empty,
and the empty text gets a score like any other. Without labelled rows all
scores are 0.5. Repeated label rows count as often as they stand there; labels
that are null do not. A text of any length is read whole, in one pass over its
bytes and words. Other columns of the input, whatever their names, are not read
by a score and pass ``keep_good`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.llm.common import bounded_batches, share, slices

#: Labelled rows that a model is fitted on at most.
MAX_ROWS = 20_000
#: A document with a lower score is predicted as bad.
THRESHOLD = 0.3
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 6
RATE, RIDGE = 0.15, 1.0

_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "#*$%&<>"]] = True
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "marks", "exclamations", "bars", "capitals", "digits", "other_bytes",
    "stops", "lines", "repeated_lines", "different_words", "longest_word", "short_words",
)


def features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    w, b, k = max(len(words), 1), max(len(raw), 1), max(len(lines), 1)
    blanks = int(n[9:14].sum() + n[32])
    different = set(words)
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), (len(raw) - blanks) / w, float(n[_MARKS].sum()) / w, n[33] / w, n[124] / w,
        float(n[65:91].sum()) / b, float(n[48:58].sum()) / b, float(n[128:].sum()) / b, float(n[46] + n[44]) / w, len(lines) / w,
        1 - len(set(lines)) / k, len(different) / w, float(np.log1p(max(map(len, different), default=0))), sum(len(x) <= 3 for x in different) / max(len(different), 1),
    ]


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, f], side="right")]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.pair_edges[f], x[:, f], side="right"), np.searchsorted(self.pair_edges[g], x[:, g], side="right")]
        return 1 / (1 + np.exp(-z))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _value(g, h):
    return g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best gain of one cut of a histogram, and where; (0, 0) if there is none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gs, hs = g.sum(), h.sum()
    gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
    at = int(gain.argmax())
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values, bin by bin, of a tree with at most two cuts."""
    _, first = _cut(g, h)
    parts = [(0, first), (first, len(g))] if first else [(0, len(g))]
    if first:
        found = [(*_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(found, key=lambda x: x[0])
        if gain > 0:
            parts = [p for p in parts if p != (a, b)] + [(a, a + at), (a + at, b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = _value(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best gain of one cut on either axis of a grid, and the leaf values cell by cell."""
    cg, ch = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    gs, hs = cg[-1, -1], ch[-1, -1]
    a, b = cg[1:-1, 1:-1], ch[1:-1, 1:-1]
    top, top_h, left, left_h = cg[1:-1, -1:], ch[1:-1, -1:], cg[-1:, 1:-1], ch[-1:, 1:-1]
    sums = [(a, b), (top - a, top_h - b), (left - a, left_h - b), (gs - top - left + a, hs - top_h - left_h + b)]
    gain = sum(x**2 / (y + RIDGE) for x, y in sums) - gs**2 / (hs + RIDGE)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for rows, cols, (x, y) in (
        (slice(0, i + 1), slice(0, j + 1), sums[0]), (slice(0, i + 1), slice(j + 1, None), sums[1]),
        (slice(i + 1, None), slice(0, j + 1), sums[2]), (slice(i + 1, None), slice(j + 1, None), sums[3]),
    ):
        out[rows, cols] = _value(x[i, j], y[i, j])
    return float(gain[i, j]), out


def fit_rows(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting over bounded rows."""
    m = Model()
    if not len(y):
        return m
    share_good = (y.sum() + 0.5) / (len(y) + 1)
    m.base = float(np.log(share_good / (1 - share_good)))
    k = x.shape[1]
    m.edges = [_edges(x[:, f], BINS) for f in range(k)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(m.edges)]
    z = np.full(len(y), m.base)
    for _ in range(ROUNDS):
        for f in range(k):
            p = 1 / (1 + np.exp(-z))
            size = len(m.tables[f])
            step = RATE * _tree(np.bincount(bins[f], y - p, size), np.bincount(bins[f], p * (1 - p), size))
            m.tables[f] += step
            z += step[bins[f]]
    m.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(k)]
    cells = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(m.pair_edges)]

    def grid(f: int, g: int, v: np.ndarray) -> np.ndarray:
        shape = (len(m.pair_edges[f]) + 1, len(m.pair_edges[g]) + 1)
        return np.bincount(cells[f] * shape[1] + cells[g], v, shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-z))
    gains = [(_quadrants(grid(f, g, y - p), grid(f, g, p * (1 - p)))[0], f, g) for f in range(k) for g in range(f + 1, k)]
    m.pairs = [(f, g) for _, f, g in sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[:PAIRS]]
    m.pair_tables = [np.zeros((len(m.pair_edges[f]) + 1, len(m.pair_edges[g]) + 1)) for f, g in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for t, (f, g) in enumerate(m.pairs):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _quadrants(grid(f, g, y - p), grid(f, g, p * (1 - p)))[1]
            m.pair_tables[t] += step
            z += step[cells[f], cells[g]]
    return m


def _columns(batch: pa.RecordBatch, name: str = "text") -> np.ndarray:
    rows = [features(t) for t in batch.column(name).to_pylist()]
    return np.array(rows, float).reshape(len(rows), len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on the documents that ``labels`` (id, 0 or 1) marks; the caller leaves out rows that are held out."""
    bounded_batches(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    marks = share(marks, max_rows, F.col("id"), F.col("y")).limit(2 * max_rows)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # the marks are at most about max_rows rows
    rows = d.join(F.broadcast(marks), "id").mapInArrow(
        lambda batches: (
            pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(list(_columns(b)), pa.list_(pa.float64()))], ["id", "y", "x"]) for b in batches
        ),
        f"id {dict(d.dtypes)['id']}, y int, x array<double>",
    ).orderBy("id", "y", "x").limit(4 * max_rows).collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit_rows(x, np.array([float(r["y"] > 0) for r in rows]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of each document."""
    bounded_batches(docs.sparkSession)
    d = docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS string) AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(_columns(b)))], ["doc_id", "score"])

    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold; nothing is shuffled."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            yield b.filter(pa.array(model.scores(_columns(b, text_col)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
