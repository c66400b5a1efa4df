"""Tokens, keywords and lexical scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the keyword index leaves out.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "this", "that", "these", "those",
)
MIN_LENGTH = 3
# Terms that count as keywords wherever they occur.
DEED_KEYWORDS = ("ที่ดิน", "โฉนด", "นส3", "นส4", "ส.ค.1", "อำเภอ", "ตำบล", "จังหวัด")


def tokens(c: Column) -> Column:
    """Lower-cased words of three characters or more that are no stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.filter(words, lambda w: (F.length(w) >= MIN_LENGTH) & ~w.isin(*STOP_WORDS))


def counted(words: Column) -> Column:
    """Each different word and how often it occurs (term, c), in the row: the words in order are cut where a run of equal ones begins."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda w, i: F.when((i == 0) | (w != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        cut = lambda b: F.transform(b, lambda at, j: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(b, j + 1), F.size(s)) - at).cast("long").alias("c")))
        return F.transform(F.array(begins), cut)[0]

    return F.transform(F.array(F.sort_array(words)), runs)[0]


def query_keywords(c: Column) -> Column:
    """Terms with a Thai letter or over two characters, and the deed keywords that occur; each once, sorted."""
    low = F.lower(c)
    terms = F.split(F.translate(low, ",.", "  "), r"\s+")
    terms = F.filter(terms, lambda t: t.rlike(r"[\x{0E00}-\x{0E7F}]") | (F.length(t) > 2))
    known = F.array_compact(F.array(*[F.when(low.contains(k), F.lit(k)) for k in DEED_KEYWORDS]))
    return F.array_sort(F.array_distinct(F.concat(terms, known)))


def occurrences(text: Column, word: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)


def frequency_score(text: Column, keywords: Column) -> Column:
    """A tenth per occurrence, by keyword, one at most."""
    total = F.aggregate(keywords, F.lit(0.0), lambda s, k: s + occurrences(F.lower(text), k) * 0.1)
    return F.when(F.size(keywords) > 0, F.least(total / F.size(keywords), F.lit(1.0))).otherwise(F.lit(0.0))


def words_of(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))


def overlap(query: Column, text: Column) -> Column:
    """The share of a query's words that a text has."""
    q = words_of(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words_of(text))) / F.size(q)).otherwise(F.lit(0.0))
