"""Quality rules as a short-circuit cascade of column expressions.

Everything here is DataFrame functions: word, symbol, line and repetition
counts are array expressions over the text of one row, so the plan has no
shuffle. A rule is a boolean expression that is true for a document to reject,
with its work: how many characters its functions go through on a row.
``plan_cascade`` takes a sample by a hash of id and text and gets, in one
aggregation, the share of rows that each rule rejects and its mean work, and
orders the rules by rejection per work; ``cascade`` chains them in one CASE, so
a row that one rule rejects evaluates none of the later ones. The order changes
cost only, never a verdict, and is the same whenever it is planned.

``apply_rules`` returns all counts, which it so computes for each row.
``keep_good`` returns only the rows that stay: there lines and repeated windows
are counted inside the rules that ask for them, so rows that are rejected
before never are.

Null text counts as the empty text: no words, so the base rejects it. A text of
any length is counted whole. Lines are compared as they are; ties and repeated
rows get equal verdicts; an empty table gives an empty result, its rules in the
order of their names. Other columns may have any names: they are not read, and
pass ``keep_good`` unchanged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslode.llm.common import share

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which rules are measured, about; it bounds the cost of planning and touches no verdict.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """``reject``: SQL expression over the columns of ``measure``, true for a row to reject. ``work``: what it costs beside these."""

    name: str
    reject: str
    work: str = "1"


@dataclass(frozen=True)
class Measured:
    rule: Rule
    rejected: float
    work: float

    @property
    def value(self) -> float:
        return self.rejected / max(self.work, 1.0)


BASE = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
BASE_RULES = (Rule("few_words", "n_words < 10"), Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"))
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * size(split(text, '\n'))", "length(text)"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("capitals", "10 * (length(text) - length(regexp_replace(text, '[A-Z]', ''))) > 4 * word_chars", "4 * length(text)"),
    Rule("exclamations", "2 * (length(text) - length(translate(text, '!', ''))) > n_words", "length(text)"),
)

_WORDS = r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"
_WINDOWS = """CASE WHEN size(words) >= 5 THEN transform(sequence(0, size(words) - 5),
    i -> xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]))
    ELSE CAST(array() AS array<bigint>) END"""
# only texts in which two window hashes agree sort their windows and merge the covered spans
_COVERED = """coalesce(aggregate(
    CASE WHEN size(array_distinct(windows)) = size(windows) THEN NULL ELSE
      sort_array(flatten(transform(array(sort_array(transform(windows, (h, i) -> struct(h, i)))), s ->
        transform(filter(s, (x, i) -> coalesce(x.h = get(s, i - 1).h, false) OR coalesce(x.h = get(s, i + 1).h, false)), x -> x.i)))) END,
    named_struct('n', 0L, 'last', -5L),
    (a, p) -> named_struct('n', a.n + least(5L, p - a.last), 'last', CAST(p AS bigint)), a -> a.n), 0L)"""
_DUP_LINES = r"""CAST(transform(array(filter(split(text, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')),
    x -> size(x) - size(array_distinct(x)))[0] AS bigint)"""
#: Counts that ``keep_good`` leaves to the rules that ask for them: as an expression of the text, and its work.
_LATE = {
    "n_dup_lines": (_DUP_LINES, "3 * length(text)"),
    "n_repeat_words": (f"transform(array({_WORDS}), words -> transform(array({_WINDOWS}), windows -> {_COVERED})[0])[0]", "12 * length(text)"),
}


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")


def _early(text: str = "text") -> list[Column]:
    return [
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the five counts of each document.

    n_repeat_words counts the words inside any 5-word window that the text
    holds twice or more; windows are compared by a 64-bit hash.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), _text(text_col))
    d = d.withColumn("words", F.expr(_WORDS)).withColumn("windows", F.expr(_WINDOWS))
    return d.select("doc_id", "text", F.size("words").cast("long").alias("n_words"), *_early(), F.expr(_DUP_LINES).alias("n_dup_lines"), F.expr(_COVERED).alias("n_repeat_words"))


def _named(rule: Rule) -> list[str]:
    return [m for m in _LATE if re.search(rf"\b{m}\b", rule.reject)]


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", late: bool = False, sample_rows: int = SAMPLE_ROWS) -> list[Measured]:
    """The rules by rejection per work, best first, as about ``sample_rows`` rows tell them; ``late``: with the work of late counts."""
    if not rules:
        return []
    sample = measure(share(docs, sample_rows, F.col(id_col), F.col(text_col)), id_col, text_col)
    shares = [F.avg(F.expr(f"CAST(coalesce({r.reject}, false) AS int)")) for r in rules]
    work = [F.avg(F.expr(" + ".join([r.work, *(_LATE[m][1] for m in _named(r) if late)]))) for r in rules]
    found = sample.agg(*shares, *work).first()
    measured = [Measured(r, float(found[i] or 0), float(found[len(rules) + i] or 0)) for i, r in enumerate(rules)]
    return sorted(measured, key=lambda m: (-m.value, m.rule.name))


def cascade(rules: list[Rule], late: bool = False) -> Column:
    """Name of the first rule that rejects the row, in the order given; null for a row to keep."""
    if not rules:
        return F.lit(None).cast("string")

    def reject(r: Rule) -> str:
        out = r.reject
        for m in _named(r) if late else ():
            out = re.sub(rf"\b{m}\b", lambda _, m=m: f"({_LATE[m][0]})", out)
        return out

    return F.expr(f"CASE {' '.join(f"WHEN {reject(r)} THEN '{r.name}'" for r in rules)} END")


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its counts, base_failed and kept."""
    order = [m.rule for m in plan_cascade(docs, rules, id_col, text_col)]
    judged = measure(docs, id_col, text_col).withColumn("base_failed", F.expr(BASE))
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order).isNull())
    return judged.withColumn("kept", verdict).drop("text")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    order = [m.rule for m in plan_cascade(docs, rules, id_col, text_col, late=True)]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _text(text_col))
    d = d.select("row", "text", F.expr(r"CAST(regexp_count(text, '[^\\x20\\x09-\\x0D]+') AS bigint)").alias("n_words"), *_early())
    return d.where(cascade(order, late=True).isNull()).select("row.*")
