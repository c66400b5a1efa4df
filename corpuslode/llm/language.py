"""Language identification by words first, then by shorter and shorter character n-grams.

Fitting counts, in Spark, the lower-cased words of labelled documents by
language and the character n-grams of those words. The model keeps the most
frequent words and n-grams of each language within ``max_entries`` entries
over all languages, so what is broadcast does not grow with the corpus. A word
that the model knows adds its log frequency in each language. An unseen word
adds the mean over its positions of the longest known n-gram there, from four
characters down to one, so that it weighs as one word.

Null text, and text without a letter, is ``und`` with score 0. With no
labelled row everything is ``und``. Ties go to the language code that sorts
first. Rows without a language take no part in fitting; repeated rows count as
often as they stand there. A text of any length is scored whole; one with more
different words than a worker's cache is scored in pieces. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslode.llm.common import bounded_batches, share

UNKNOWN = "und"
#: Labelled documents a model is fitted on at most, a random share of all of them.
MAX_TRAIN_DOCS = 20_000
#: Words and n-grams of all languages together.
MAX_ENTRIES = 400_000
MAX_GRAM = 4
#: Unseen words whose vectors a worker keeps.
CACHE_WORDS = 300_000

_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int] = field(default_factory=dict)
    word_logs: np.ndarray | None = None
    grams: dict[str, int] = field(default_factory=dict)
    gram_logs: np.ndarray | None = None


def _logs(rows: list, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Log frequencies with add-half smoothing; rows: (lang, key, n), totals over what was kept."""
    index: dict[str, int] = {}
    for r in rows:
        index.setdefault(r["k"], len(index))
    counts = np.full((len(index) or 1, len(languages)), 0.5)
    at = {x: i for i, x in enumerate(languages)}
    for r in rows:
        counts[index[r["k"]], at[r["lang"]]] += r["n"]
    return index, np.log(counts / counts.sum(axis=0))


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_train_docs: int = MAX_TRAIN_DOCS,
    max_entries: int = MAX_ENTRIES,
) -> Model:
    """Fit on rows of ``docs`` that have a language and a text."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = share(d.where("lang IS NOT NULL AND text IS NOT NULL"), max_train_docs, F.col("id"), F.col("text"))
    words = (
        d.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("k")).groupBy("lang", "k").agg(F.count("*").alias("n"))
    ).cache()
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    if not languages:
        words.unpersist()
        return Model([])
    each = max(1, max_entries // (len(languages) * (MAX_GRAM + 1)))
    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), "k")
    top_words = words.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= each).collect()
    marked = words.withColumn("m", F.concat(F.lit("^"), "k", F.lit("$")))
    grams = (
        marked.select("lang", "n", F.explode(F.expr(
            f"flatten(transform(sequence(1, {MAX_GRAM}), g -> transform(sequence(1, greatest(length(m) - g + 1, 1)), i -> substring(m, i, g))))")).alias("k"))
        .groupBy("lang", "k").agg(F.sum("n").alias("n")).withColumn("g", F.length("k"))
    )
    ranked = Window.partitionBy("lang", "g").orderBy(F.desc("n"), "k")
    top_grams = grams.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= each).collect()
    words.unpersist()
    key = lambda r: (r["k"], r["lang"])
    return Model(languages, *_logs(sorted(top_words, key=key), languages), *_logs(sorted(top_grams, key=key), languages))


class Scorer:
    """Scores texts in one Python worker; keeps the vectors of words it has met."""

    def __init__(self, model: Model, cache_words: int = CACHE_WORDS):
        self.m = model
        self.known = len(model.words)
        self.rows = np.zeros((self.known + cache_words, len(model.languages)))
        if self.known:
            self.rows[: self.known] = model.word_logs
        self.index = dict(model.words)

    def unseen(self, word: str) -> np.ndarray:
        s, grams, at = f"^{word}$", self.m.grams, []
        for i in range(len(s)):
            for n in range(min(MAX_GRAM, len(s) - i), 0, -1):
                g = grams.get(s[i : i + n])
                if g is not None:
                    at.append(g)
                    break
        return self.m.gram_logs[at].mean(axis=0) if at else np.zeros(len(self.m.languages))

    def __call__(self, text: str | None) -> tuple[str, float]:
        found = Counter(_WORDS.findall(text.lower())) if text and self.m.languages else {}
        if not found or not any(c.isalpha() for w in found for c in w):
            return UNKNOWN, 0.0
        total = np.zeros(len(self.m.languages))
        # a text with more words than the cache holds is scored in pieces
        items = list(found.items())
        step = max(1, len(self.rows) - self.known)
        for a in range(0, len(items), step):
            part = items[a : a + step]
            new = [w for w, _ in part if w not in self.index]
            if len(self.index) + len(new) > len(self.rows):
                self.index = dict(self.m.words)
                new = [w for w, _ in part if w not in self.index]
            for w in new:
                self.rows[len(self.index)] = self.unseen(w)
                self.index[w] = len(self.index)
            at = [self.index[w] for w, _ in part]
            total += np.array([n for _, n in part], float) @ self.rows[at]
        best = int(total.argmax())
        return self.m.languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each document; reads nothing but its text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_ENTRIES entries
    d = docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS string) AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for b in batches:
            found = [score(t) for t in b.column("text").to_pylist()]
            langs, scores = pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), langs, scores], ["doc_id", "lang_pred", "score"])

    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, lang_pred string, score double")
