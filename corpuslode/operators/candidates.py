"""Candidate sets as bitmaps, and searches that begin with them where that is worth it.

``bitmap_index`` has, for each value of a field and each range of 32,768 ids, one
bit an id: a value's rows are added up by tasks before they are shuffled, so a
value that a third of all rows have is no hot key. Filters become bitmaps by OR
over the values of one filter, and AND or OR over filters; counting them reads
no node. A search begins with the candidates if they are fewer than
``CANDIDATE_SHARE`` of all nodes: the nodes are then semi-joined to the ranges
that have candidates, and looked up in the bitmap. Else the filters are only
predicates, since nearly all nodes would pass the join. Both ways give the same
rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslode.operators.filters import Filter, where, worth_prefiltering
from corpuslode.operators.ranking import TOP_K, search


def bitmap_index(nodes: DataFrame, fields: Sequence[str], key: str = "node_id") -> DataFrame:
    """field, value (as text), bucket and bits: one row for each value and range of ids. Ids are whole numbers; null values have no bitmap.

    The field '' has all nodes.
    """
    values = F.explode(F.array(F.struct(F.lit("").alias("field"), F.lit("").alias("value")), *[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields]))
    each = nodes.select(F.col(key).cast("long").alias("id"), values.alias("v")).where("v.value IS NOT NULL")
    grouped = each.groupBy(F.col("v.field").alias("field"), F.col("v.value").alias("value"), F.bitmap_bucket_number("id").alias("bucket"))
    return grouped.agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def _of(index: DataFrame, f: Filter) -> DataFrame:
    """bucket and bits of the nodes with one of a filter's values: EQ and IN on text, ranges on numbers."""
    v = F.col("value")
    if f.operator in ("EQ", "IN"):
        values = [str(x) for x in (f.value if f.operator == "IN" else [f.value])]
        kept = v.isin(values)
    else:
        n = v.cast("double")
        kept = {"GT": n > f.value, "GTE": n >= f.value, "LT": n < f.value, "LTE": n <= f.value}[f.operator]
    return index.where((F.col("field") == f.key) & kept).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def candidates(index: DataFrame, filters: Iterable[Filter], how: str = "and") -> DataFrame:
    """bucket and bits of the nodes that pass all filters, or any (``how`` = or); of no filters all nodes."""
    filters = list(filters)
    found = [_of(index, f) for f in filters] or [index.where("field = ''").select("bucket", "bits")]
    both = reduce(DataFrame.unionByName, found).groupBy("bucket")
    if how == "or":
        return both.agg(F.bitmap_or_agg("bits").alias("bits"))
    # a range of ids that one filter has nothing in has no candidates
    return both.agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where(F.col("n") == len(found)).select("bucket", "bits").where(F.bitmap_count("bits") > 0)


def bit_of(bits: Column, key: Column) -> Column:
    """Whether an id's bit is set in the bitmap of its range."""
    at = F.bitmap_bit_position(key)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False))


def only(nodes: DataFrame, found: DataFrame, key: str = "node_id") -> DataFrame:
    """The nodes whose bit is set: a join on the range of ids, one row of bits for each."""
    ranged = found.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    inside = F.bitmap_bucket_number(F.col(key).cast("long")) == F.col("__bucket")
    return nodes.join(ranged, inside & bit_of(F.col("__bits"), F.col(key).cast("long")), "left_semi")


def decision(index: DataFrame, filters: Iterable[Filter], how: str = "and") -> tuple[int, int]:
    """Candidates and nodes, counted in the bitmaps."""
    count = lambda df: df.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).first()[0]
    return count(candidates(index, filters, how)), count(index.where("field = ''"))


def steered_search(nodes: DataFrame, index: DataFrame, filters: Sequence[Filter], vector: Sequence[float], k: int = TOP_K, how: str = "and", key: str = "node_id") -> DataFrame:
    """The k most similar nodes that pass the filters, begun with the candidates where these are few enough."""
    if worth_prefiltering(*decision(index, filters, how)):
        return search(only(nodes, candidates(index, filters, how), key), vector, k, key=key)
    return search(where(nodes, filters, how), vector, k, key=key)
