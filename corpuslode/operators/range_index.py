"""Numeric fields kept in order, so that a comparison opens the zones that its bound cuts and no others.

``write`` lays each field out by itself: ``<path>/<field>/values/zone=<n>`` has value and id in order, each zone a range of values, numbered
in their order; ``<path>/<field>/zones`` has a row for each zone with its least and greatest value and its number of rows. A value that many
nodes share is cut by id, so no zone outgrows the others. Rows without a value are in no zone, as no comparison is true of them; NaN
counts as greater than all numbers. Ids should be unique: filters are combined by id.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslode.operators.filters import Filter, predicate

#: Rows of a zone, and zones up to which smaller ones are made.
ZONE_ROWS, MOST_ZONES = 4_000_000, 256


def write(nodes: DataFrame, path: str, fields: Sequence[str], id_col: str = "node_id", zone_rows: int = ZONE_ROWS) -> None:
    """One sort of each field's values and ids; other columns are not read."""
    spark = nodes.sparkSession
    sizes = nodes.agg(*[F.count(F.col(f"`{f}`")) for f in fields]).first()
    for field, n in zip(fields, sizes, strict=True):
        some = nodes.select(F.col(f"`{field}`").alias("value"), F.col(f"`{id_col}`").alias("node_id")).where(F.col("value").isNotNull())
        zone = max(zone_rows, min(ZONE_ROWS, ceil(n / MOST_ZONES)))
        placed = some.repartitionByRange(max(1, ceil(n / zone)), "value", "node_id").withColumn("zone", F.spark_partition_id())
        placed.sortWithinPartitions("zone", "value", "node_id").write.mode("overwrite").partitionBy("zone").parquet(f"{path}/{field}/values")
        stored = spark.read.schema(placed.schema).parquet(f"{path}/{field}/values")
        zones = stored.groupBy("zone").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min("node_id").alias("first_id"), F.count("*").alias("n"))
        zones.write.mode("overwrite").parquet(f"{path}/{field}/zones")


def _stored(spark: SparkSession, path: str, field: str) -> tuple[DataFrame, DataFrame]:
    zones = spark.read.parquet(f"{path}/{field}/zones")
    kind = T.StructType([T.StructField("value", zones.schema["low"].dataType), T.StructField("node_id", zones.schema["first_id"].dataType), T.StructField("zone", T.IntegerType())])
    return zones, spark.read.schema(kind).parquet(f"{path}/{field}/values")


def _parts(f: Filter) -> list[Filter]:
    return [replace(f, value=v, operator="EQ") for v in f.value] if f.operator == "IN" else [f]


def _touched(zones: DataFrame, f: Filter, whole: bool, compat_range: bool) -> Column:
    """Zones with a value for which ``f`` can be true, or those of whose values it is true without exception."""
    at = lambda side, operator: predicate(zones, replace(f, key=side, operator=operator), compat_range)
    if f.operator == "EQ":
        return at("low", "EQ") & at("high", "EQ") if whole else predicate(zones, replace(f, key="low", operator="LTE")) & predicate(zones, replace(f, key="high", operator="GTE"))
    upward = f.operator in ("GT", "GTE")
    return at("low" if upward == whole else "high", f.operator)


def search(spark: SparkSession, path: str, f: Filter, compat_range: bool = False) -> DataFrame:
    """Ids of the nodes for which ``f`` is true: folders of other zones are pruned, in those left the bound is pushed into the scan."""
    zones, values = _stored(spark, path, f.key)
    parts = _parts(f)
    if not parts:
        return values.where(F.lit(False)).select("node_id")
    # zones are in the order of values, so those of a bound follow each other: two numbers for each
    spans = [F.when(_touched(zones, p, False, compat_range), F.col("zone")) for p in parts]
    found = zones.agg(*[end(s) for s in spans for end in (F.min, F.max)]).first()
    asked = [F.col("zone").between(a, b) & predicate(values, replace(p, key="value"), compat_range) for p, a, b in zip(parts, found[::2], found[1::2], strict=True) if a is not None]
    return values.where(reduce(lambda a, b: a | b, asked, F.lit(False))).select("node_id")


def count(spark: SparkSession, path: str, f: Filter, compat_range: bool = False) -> DataFrame:
    """One row: nodes for which ``f`` is true (``n``), zones there are and zones opened to count them.

    Zones that lie inside are counted by their sizes; of each value only the zones at its two ends are opened.
    """
    zones, values = _stored(spark, path, f.key)
    no = F.lit(False)
    parts = _parts(f)
    inside = reduce(lambda a, b: a | b, [_touched(zones, p, True, compat_range) for p in parts], no)
    near = reduce(lambda a, b: a | b, [_touched(zones, p, False, compat_range) for p in parts], no)
    cut = [r["zone"] for r in zones.where(near & ~inside).select("zone").collect()]  # two for each value at most
    true = reduce(lambda a, b: a | b, [predicate(values, replace(p, key="value"), compat_range) for p in parts], no)
    sizes = zones.agg(F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("m"), F.count("*").alias("zones"))
    rest = values.where(F.col("zone").isin(cut) & true).agg(F.count("*").alias("m"), F.lit(0).cast("long").alias("zones"))
    return sizes.union(rest).agg(F.sum("m").alias("n"), F.sum("zones").alias("zones"), F.lit(len(cut)).cast("long").alias("opened"))


def where(spark: SparkSession, path: str, filters: Iterable[Filter], how: str = "and", compat_range: bool = False) -> DataFrame:
    """Ids of the nodes for which all filters are true, or one of them; each filter is answered by its own field."""
    found = [search(spark, path, f, compat_range) for f in filters]
    if how == "and":
        return reduce(lambda a, b: a.join(b, "node_id", "left_semi"), found)
    return reduce(DataFrame.union, found).distinct()
