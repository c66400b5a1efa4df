"""Metadata filters as column predicates: EQ, IN, GT, GTE, LT, LTE, joined by AND or OR, and inferred from queries.

Numbers are compared in the column's own type, and exact text as it is stored,
so both are pushed into the Parquet scan. Text that is compared without case and
outer blanks cannot be; ``spelled`` looks its stored spellings up in the value
inventory and gives exact filters for them. An empty group means "no filter". A
filter on an unknown column matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce
from math import ceil, floor, isfinite
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslode.functions.values import area_from_text

OPERATORS = ("EQ", "IN", "GT", "GTE", "LT", "LTE")
# English provinces that queries name, spelled as they are stored.
QUERY_PROVINCES = ("bangkok", "chiang mai", "phuket", "rayong", "chonburi")
#: Share of rows above which a pre-filter is not worth its join (fixed value).
CANDIDATE_SHARE = 0.8


@dataclass(frozen=True)
class Filter:
    """``exact``: text is compared as it is stored."""

    key: str
    value: Any
    operator: str = "EQ"
    exact: bool = False


def _compared(df: DataFrame, key: str, operator: str, value: Any) -> Column:
    """A number against a column, in the column's type: a bound between two of its whole numbers moves to the one that decides alike."""
    c, kind = F.col(f"`{key}`"), df.schema[key].dataType
    if isinstance(kind, T.IntegralType) and isfinite(number := value if isinstance(value, int) else float(value)):
        if operator == "EQ" and number != floor(number):
            return F.lit(False)
        number = floor(number) if operator in ("EQ", "GT", "LTE") else ceil(number)
        edge = 1 << (8 * {"tinyint": 1, "smallint": 2, "int": 4}.get(kind.simpleString(), 8) - 1)
        v = F.lit(number).cast(kind) if -edge <= number < edge else F.lit(Decimal(number))
    elif isinstance(kind, T.DecimalType):
        v = F.lit(Decimal(str(value)))
    elif isinstance(kind, T.FractionalType):
        v = F.lit(float(value)).cast(kind)
    else:
        c, v = c.cast("double"), F.lit(float(value))
    return {"EQ": c == v, "GT": c > v, "GTE": c >= v, "LT": c < v, "LTE": c <= v}[operator]


def _equal(df: DataFrame, f: Filter, value: Any) -> Column:
    c = F.col(f"`{f.key}`")
    if isinstance(df.schema[f.key].dataType, T.ArrayType):
        return F.array_contains(c, value)
    if isinstance(value, str):
        return c == value if f.exact else F.lower(F.trim(c.cast("string"))) == value.strip().lower()
    return _compared(df, f.key, "EQ", value)


def predicate(df: DataFrame, f: Filter, compat_range: bool = False) -> Column:
    """F1-F3, F5. ``compat_range``: GT also takes equal values and LTE leaves them out."""
    if f.key not in df.columns or f.operator not in OPERATORS:
        return F.lit(False)
    if f.operator == "EQ":
        return _equal(df, f, f.value)
    if f.operator == "IN":
        values = list(f.value)
        if f.exact and values and all(isinstance(v, str) for v in values) and not isinstance(df.schema[f.key].dataType, T.ArrayType):
            return F.col(f"`{f.key}`").isin(values)
        return reduce(lambda a, b: a | b, [_equal(df, f, v) for v in values], F.lit(False))
    at = {"GT": "GTE", "LTE": "LT"}.get(f.operator, f.operator) if compat_range else f.operator
    return _compared(df, f.key, at, f.value)


def spelled(df: DataFrame, filters: Iterable[Filter]) -> list[Filter]:
    """Text filters of EQ and IN as exact ones over the spellings that ``df`` holds of their values (one pass over those columns)."""

    def text(f: Filter) -> bool:
        return f.operator in ("EQ", "IN") and f.key in df.columns and isinstance(df.schema[f.key].dataType, T.StringType) and all(isinstance(v, str) for v in wanted(f))

    def wanted(f: Filter) -> list[Any]:
        return list(f.value) if f.operator == "IN" else [f.value]

    filters = list(filters)
    # spellings of the asked values alone, so few
    kept = [F.collect_set(F.when(predicate(df, f), F.col(f"`{f.key}`"))) for f in filters if text(f)]
    found = iter(df.agg(*kept).first() if kept else ())
    return [replace(f, value=sorted(next(found)), operator="IN", exact=True) if text(f) else f for f in filters]


def where(df: DataFrame, filters: Iterable[Filter], how: str = "and", compat_range: bool = False) -> DataFrame:
    """F4."""
    found = [predicate(df, f, compat_range) for f in filters]
    if not found:
        return df
    return df.where(reduce((lambda a, b: a & b) if how == "and" else (lambda a, b: a | b), found))


def from_dict(wanted: Mapping[str, Any], known: Iterable[str]) -> list[Filter]:
    """a list is IN, a scalar EQ; unknown fields go."""
    known = set(known)
    return [Filter(k, v, "IN" if isinstance(v, (list, tuple, set)) else "EQ") for k, v in wanted.items() if k in known]


def validated(wanted: Mapping[str, Any], inventory: Mapping[str, Iterable[str]]) -> dict[str, Any]:
    """only known fields with known values."""
    return {k: v for k, v in wanted.items() if k in inventory and str(v) in set(map(str, inventory[k]))}


def inferred(query: str, phrases: Mapping[str, Mapping[str, Any]] | None = None, provinces: Iterable[str] = QUERY_PROVINCES) -> dict[str, Any]:
    """what the phrases in a query stand for; later ones override."""
    low, out = query.lower(), {}
    for phrase, wanted in (phrases or {}).items():
        if phrase in low:
            out |= wanted
    for p in provinces:
        if p in low:
            out["province"] = p.title()
    return out


def by_values(df: DataFrame, column: str, values: Iterable[Any]) -> DataFrame:
    """Exact membership."""
    return df.where(F.col(column).isin(*values))


def by_area(df: DataFrame, text: str = "search_text", low: float | None = None, high: float | None = None) -> DataFrame:
    """rows whose text names an area within the bounds, both inclusive."""
    area = area_from_text(F.col(text))
    ok = area.isNotNull()
    ok = ok & (area >= low) if low is not None else ok
    return df.where(ok & (area <= high) if high is not None else ok)


def configured(
    df: DataFrame, provinces=None, deed_types=None, low_area: float | None = None, high_area: float | None = None, limit: int | None = None, order: str | None = None
) -> DataFrame:
    """All given filters, then the first ``limit`` rows in order of ``order``."""
    df = by_values(df, "province", provinces) if provinces else df
    df = by_values(df, "deed_type_category", deed_types) if deed_types else df
    df = by_area(df, low=low_area, high=high_area) if low_area is not None or high_area is not None else df
    return df if limit is None else (df.orderBy(order) if order else df).limit(limit)


def equal_all(df: DataFrame, wanted: Mapping[str, Any], compat: bool = False) -> DataFrame:
    """rows equal in all fields. ``compat``: everything where nothing matches."""
    out = where(df, [Filter(k, v) for k, v in wanted.items()])
    return df if compat and out.isEmpty() else out


def section_chunks(df: DataFrame) -> DataFrame:
    """section chunks, or all rows where there are none."""
    out = df.where((F.col("type") == "section_chunk") | F.col("chunk_type").isin("section", "section_part", "key_info"))
    return df if out.isEmpty() else out


def in_bands(df: DataFrame, length: Column, sizes=(512, 1024, 2048), tolerance: float = 0.3) -> DataFrame:
    """each row once for each size that its length is within ``tolerance`` of."""
    sizes = F.explode(F.array(*map(F.lit, sizes))).alias("size")
    return df.select("*", length.alias("length"), sizes).where(F.abs(F.col("length") - F.col("size")) < F.col("size") * tolerance)


def worth_prefiltering(hits: int, total: int) -> bool:
    """F7."""
    return 0 < hits < CANDIDATE_SHARE * total


def prefilter_plan(df: DataFrame, kept: Column) -> DataFrame:
    """F7 as a plan: rows, candidates, and whether a search should begin with them."""
    out = df.agg(F.count("*").alias("total"), F.count_if(kept).alias("candidates"))
    return out.withColumn("worth", (F.col("candidates") > 0) & (F.col("candidates") < CANDIDATE_SHARE * F.col("total")))
