"""Filters inferred from a table of queries by a table of phrases, and searches filtered by them.

A phrase stands for a value of a field; a query that holds it, wherever and in
whatever case, gets that filter. Of phrases for one field the one of the largest
place wins, and given filters win over inferred ones. Phrases are found by a join
on their first characters at every place of a query and a look at the rest, so
neither table need be small, and no pair is made that shares nothing.

Queries share few sets of filters: a search is made once for each different set.
The best nodes of each combination of the fields' values are kept first, so that
only these meet the sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a phrase that are joined on; shorter phrases are joined whole.
SEED = 4


def infer(queries: DataFrame, phrases: DataFrame) -> DataFrame:
    """query_id, field and value for queries (query_id, query) by phrases (phrase, field, value, place).

    Null or empty queries and phrases give nothing. Phrases of one place are told apart by the phrase, then the value.
    """
    known = phrases.select(F.lower("phrase").alias("phrase"), "field", "value", "place").where("phrase != ''").withColumn("seed", F.substring("phrase", 1, SEED)).withColumn("size", F.length("seed"))
    asked = queries.select("query_id", F.lower("query").alias("low")).where("low != ''")
    # sizes of seeds: at most SEED values
    at = asked.select("query_id", "low", F.explode(F.sequence(F.lit(1), F.length("low"))).alias("at"))
    sizes = known.select("size").distinct()
    seeds = at.join(F.broadcast(sizes)).select("query_id", "low", "at", "size", F.expr("substring(low, at, size)").alias("seed"))
    met = seeds.join(known, ["size", "seed"]).where(F.expr("substring(low, at, length(phrase)) = phrase"))
    last = met.groupBy("query_id", "field").agg(F.max(F.struct("place", "phrase", "value")).alias("m"))
    return last.select("query_id", "field", F.col("m.value").alias("value"))


def overridden(inferred: DataFrame, given: DataFrame) -> DataFrame:
    """given filters (query_id, field, value), and inferred ones for fields that a query has none given for."""
    columns = ("query_id", "field", "value")
    rest = inferred.join(given.select("query_id", "field").distinct(), ["query_id", "field"], "left_anti")
    return given.select(*columns).unionByName(rest.select(*columns))


def checked(answers: DataFrame, inventory: DataFrame) -> DataFrame:
    """of answers (query_id, answer: a JSON object of fields and values) those that the inventory (field, value) knows; text that is no object gives nothing."""
    each = answers.select("query_id", F.explode(F.from_json("answer", "map<string,string>")).alias("field", "value"))
    return each.join(inventory.select("field", "value").distinct(), ["field", "value"], "left_semi").select("query_id", "field", "value")


def filter_sets(filters: DataFrame) -> DataFrame:
    """query_id and its set of filters as a map; queries without filters have no row."""
    return filters.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("field", "value")))).alias("wanted"))


def search_filtered(nodes: DataFrame, queries: DataFrame, filters: DataFrame, fields: Sequence[str], score: str, k: int = 5, key: str = "node_id") -> DataFrame:
    """For each query (query_id) the k nodes of largest ``score`` that pass all its filters; without filters of all nodes.

    A filter on a field that is not one of ``fields`` matches nothing.
    """
    named = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(f"`{f}`").cast("string") for f in fields])), lambda _, v: v.isNotNull())
    order = (F.desc(score), F.asc(key))
    # of each combination of values the k best
    best = nodes.select(F.col(key), F.col(score), named.alias("has"), F.hash(*fields).alias("h"), *[F.col(f"`{f}`").alias(f"__{i}") for i, f in enumerate(fields)])
    keep = [f"__{i}" for i in range(len(fields))]
    best = best.withColumn("i", F.row_number().over(Window.partitionBy(*keep).orderBy(*order))).where(F.col("i") <= k).select(key, score, "has")
    best = best.withColumn("entries", F.map_entries("has"))

    text = lambda m: F.to_json(m)
    asked = queries.select("query_id").join(filter_sets(filters), "query_id", "left").withColumn("set", F.coalesce(text(F.col("wanted")), F.lit("{}")))
    sets = asked.groupBy("set").agg(F.first("wanted").alias("wanted"))
    pairs = sets.select("set", F.size("wanted").alias("n"), F.explode("wanted").alias("field", "value"))
    met = best.select(key, score, F.explode("entries").alias("e")).select(key, score, F.col("e.key").alias("field"), F.col("e.value").alias("value")).join(pairs, ["field", "value"])
    met = met.groupBy("set", key, score, "n").agg(F.count("*").alias("c")).where("c = n").select("set", key, score)
    free = sets.where("wanted IS NULL").select("set").join(F.broadcast(best.orderBy(*order).limit(k).select(key, score)))  # k rows beside the one empty set
    ranked = met.unionByName(free).withColumn("rank", F.row_number().over(Window.partitionBy("set").orderBy(*order))).where(F.col("rank") <= k)
    return asked.select("query_id", "set").join(ranked, "set").select("query_id", key, score, "rank")
