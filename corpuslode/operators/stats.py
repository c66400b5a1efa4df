"""Statistics of documents, chunks, embeddings, filters and retrieval logs.

Sums of money and times are sums of whole hundredths, so their rounding does
not depend on the order in which Spark adds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslode.functions.values import token_cost

# Weights of dimensions, texts, vectors and metadata in the quality score.
QUALITY_WEIGHTS = (0.2, 0.3, 0.3, 0.2)
# Upper ends of the area buckets in rai.
RAI_BUCKETS = ((1, "0-1"), (5, "1-5"), (10, "5-10"), (50, "10-50"))

#: Rows of a table up to which a running value has one window for each group.
BUCKET_ROWS = 4_000_000


def hundredths(c: Column) -> Column:
    return F.round(c * 100).cast("long")


def coverage(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """A1, A2: share of rows in which a field is given, in per cent."""
    aggs = [F.count(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns]
    wide = df.agg(F.count("*").alias("__n"), *aggs)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("given")) for c in columns])).alias("p")
    return wide.select("__n", pairs).select("p.field", "p.given", F.round(F.expr("try_divide(100.0D * p.given, __n)"), digits).alias("percent"))


def top_values(df: DataFrame, column: str, k: int = 10, missing: str | None = None) -> DataFrame:
    """The k most frequent values."""
    v = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(missing)) if missing else F.col(column).cast("string")
    return df.select(v.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def spread(df: DataFrame, column: str) -> DataFrame:
    """A1: least, largest and mean value, and how many there are; nulls without any."""
    c = F.col(column)
    return df.agg(F.min(c).alias("least"), F.max(c).alias("largest"), F.round(F.sum(hundredths(c)) / F.count(c) / 100, 6).alias("mean"), F.count(c).alias("n"))


def chunk_stats(chunks: DataFrame, by: str) -> DataFrame:
    """A3."""
    n = F.length("text")
    return chunks.groupBy(by).agg(
        F.count("*").alias("chunks"), F.round(F.sum(n) / F.count("*"), 6).alias("mean_length"),
        F.count_if(n < 200).alias("short"), F.count_if((n >= 200) & (n <= 800)).alias("medium"), F.count_if(n > 800).alias("long"),
    )


def embedding_validation(df: DataFrame, vector: str = "embedding", text: Column | None = None, kind: str | None = None) -> DataFrame:
    """Rows, dimensions, and missing vectors and texts, for each type or in all."""
    out = df.groupBy(*([kind] if kind else []))
    t = text if text is not None else F.lit(None).cast("string")
    return out.agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set(F.size(vector))).alias("dimensions"), F.count_if(F.col(vector).isNull() | (F.size(vector) <= 0)).alias("no_vector"),
        F.count_if(t.isNull() | (t == "")).alias("no_text"), F.round(F.avg(F.length(t)), 6).alias("mean_text_length"),
    )


def quality_score(df: DataFrame, vector: str, text: Column, required: Sequence[Column]) -> DataFrame:
    """A5: one row with the weighted share of what is there; a required field costs half the share of rows without it."""
    d, t, v, m = QUALITY_WEIGHTS
    wide = df.agg(
        F.count("*").alias("n"), F.count_distinct(F.size(vector)).alias("dims"), F.count_if(text.isNotNull() & (text != "")).alias("texts"), F.count_if(F.size(vector) > 0).alias("vectors"),
        *[F.count_if(c.isNull()).alias(f"missing_{i}") for i, c in enumerate(required)],
    )
    lost = sum((F.col(f"missing_{i}") / F.col("n") * 0.5 for i in range(len(required))), F.lit(0.0))
    score = d * F.when(F.col("dims") > 1, 0.5).otherwise(1.0) + t * F.col("texts") / F.col("n") + v * F.col("vectors") / F.col("n") + m * F.greatest(F.lit(0.0), 1 - lost)
    return wide.withColumn("quality_score", F.round(score, 6))


def sparse_fields(df: DataFrame, metadata: str = "metadata", share: float = 0.8) -> DataFrame:
    """Metadata keys that fewer than ``share`` of the rows have."""
    n = df.agg(F.count("*").alias("total"))
    keys = df.select(F.explode(F.map_keys(metadata)).alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    return keys.crossJoin(F.broadcast(n)).where(F.col("n") < share * F.col("total")).drop("total")


def rai_bucket(c: Column) -> Column:
    """A6."""
    out = F.when(c.isNull(), "unknown")
    for most, label in RAI_BUCKETS:
        out = out.when(c <= most, label)
    return out.otherwise("50+")


def value_inventory(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct values of each field, one row each."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return df.select(pairs).select("p.*").where("value IS NOT NULL AND value != ''").distinct()


def totals(df: DataFrame, batch: Column, kind: Column) -> DataFrame:
    """A10: rows for each batch and type, each batch, and in all."""
    return df.rollup(batch.alias("batch"), kind.alias("type")).agg(F.count("*").alias("n"))


def index_size(df: DataFrame, keywords: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Different keyword values and numeric entries."""
    return df.agg(*[F.count_distinct(F.lower(F.trim(F.col(c).cast("string")))).alias(f"keyword_{c}") for c in keywords], *[F.count(c).alias(f"numeric_{c}") for c in numbers])


def inverted_index(df: DataFrame, key: str, keywords: Sequence[str]) -> DataFrame:
    """(field, value, node_id) of each keyword field."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.lower(F.trim(F.col(c).cast("string"))).alias("value")) for c in keywords])).alias("p")
    return df.select(F.col(key).alias("node_id"), pairs).select("p.field", "p.value", "node_id").where("value IS NOT NULL")


def filter_ratio(df: DataFrame, kept: Column) -> DataFrame:
    """Rows before and behind a filter."""
    return df.agg(F.count("*").alias("original"), F.count_if(kept).alias("filtered"), F.round(F.expr("try_divide(1D, count(*))") * F.count_if(kept), 6).alias("ratio"))


def running(df: DataFrame, sums: dict[str, Column], order: Sequence[str], by: Sequence[str] = (), rows: int = BUCKET_ROWS) -> DataFrame:
    """Running sums of columns over each group's rows in an order, without a task for a whole group.

    A table of more than ``rows`` rows is cut by quantiles of the first order
    column, a number or a time, into buckets of about as many rows; each bucket
    of a group is summed on its own, and what stands before it is added.
    """
    n, first = df.count(), order[0]
    cuts = min(n // rows, 5000) if isinstance(df.schema[first].dataType, (T.NumericType, T.DatetimeType)) else 0
    if not cuts:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})
    edges = df.agg(F.percentile_approx(first, [i / (cuts + 1) for i in range(1, cuts + 1)]).alias("e"))  # one row
    df = df.withColumns({f"__{name}": c for name, c in sums.items()}).crossJoin(F.broadcast(edges))
    df = df.withColumn("__bucket", F.size(F.filter("e", lambda x: x < F.col(first)))).drop("e")
    w = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, "__bucket").agg(*[F.sum(f"__{name}").alias(name) for name in sums])
    totals = totals.select("__bucket", *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], *[F.sum(name).over(before).alias(f"__before_{name}") for name in sums])
    same = [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]
    out = df.join(totals.withColumnRenamed("__bucket", "__at"), reduce(lambda x, y: x & y, same, F.col("__bucket") == F.col("__at")))
    kept = [c for c in df.columns if not c.startswith("__")]
    here, earlier = (lambda name: F.sum(f"__{name}").over(w)), (lambda name: F.col(f"__before_{name}"))
    return out.select(*kept, *[F.coalesce(here(name) + earlier(name), here(name), earlier(name)).alias(name) for name in sums])


def running_mean(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), digits: int = 6, rows: int = BUCKET_ROWS) -> DataFrame:
    """The mean of the rows so far."""
    sums = {"run_sum": hundredths(F.col(value)), "run_n": F.when(F.col(value).isNotNull(), 1).otherwise(0)}
    out = running(df, sums, order, by, rows)
    return out.withColumn("running_mean", F.round(F.col("run_sum") / F.nullif(F.col("run_n"), F.lit(0)) / 100, digits)).drop("run_sum", "run_n")


def accuracy(df: DataFrame, predicted: Column, expected: Column) -> DataFrame:
    """0 for an empty table."""
    return df.agg(F.count("*").alias("total"), F.count_if(predicted == expected).alias("correct")).withColumn("accuracy", F.round(F.coalesce(F.expr("try_divide(correct, total)"), F.lit(0.0)), 6))


# ---------------------------------------------------------------------- logs
# Entries: strategy, index, latency_ms, prompt_tokens, completion_tokens, error (null if there was none).


def log_summary(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and success rate."""
    return log.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("errors")).withColumn(
        "success_rate", F.round(F.expr("try_divide(100.0D * success, total)"), 1))


def ordered_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Different values of a column with their number k, the number of rows up to them (upto) and of all (n), for each group.

    Equal values are counted first, in every task; running sums are in buckets, so no task holds a whole group.
    """
    counts = df.groupBy(*by, column).agg(F.count("*").alias("k"))
    totals = counts.groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]).agg(F.sum("k").alias("n"))
    rows = running(counts, {"upto": F.col("k")}, [column], by)
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)]
    rows = rows.join(totals, reduce(lambda x, y: x & y, same)) if same else rows.crossJoin(F.broadcast(totals))  # one row
    return rows.select(*by, column, "k", "upto", "n")


def _at(column: str, place: Column) -> Column:
    """The value at a place of the ordered rows, counted from zero."""
    return F.min(F.when(F.col("upto") > place, F.col(column)))


def _median(column: str) -> Column:
    return (_at(column, F.floor((F.col("n") - 1) / 2)) + _at(column, F.floor(F.col("n") / 2))) / 2


def log_latency(log: DataFrame, by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Mean, median, 95th percentile (the value at place n * 0.95 of the sorted ones), least and largest latency."""
    c = F.col("latency_ms")
    rows = ordered_counts(log.where(c > 0), "latency_ms", by)
    return rows.groupBy(*by).agg(
        F.sum("k").alias("n_entries"), F.round(F.sum(hundredths(c) * F.col("k")) / F.sum("k") / 100, digits).alias("mean_ms"), F.round(_median("latency_ms"), digits).alias("median_ms"),
        _at("latency_ms", F.floor(F.col("n") * 0.95)).alias("p95_ms"), F.min(c).alias("min_ms"), F.max(c).alias("max_ms"),
    ).withColumnRenamed("n_entries", "n")


def median_cost(log: DataFrame, by: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """The median cost of the entries with tokens."""
    used = log.where((F.col("prompt_tokens") > 0) | (F.col("completion_tokens") > 0))
    cost = F.round(token_cost(F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))), digits)
    return ordered_counts(used.withColumn("cost", cost), "cost", by).groupBy(*by).agg(F.round(_median("cost"), digits + 1).alias("median_cost"))


def most_frequent(log: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values of a column, those without one left out; ties go by value."""
    return log.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def log_costs(log: DataFrame, by: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """Sum and mean cost of the entries with tokens; tokens are summed whole."""
    used = log.where((F.col("prompt_tokens") > 0) | (F.col("completion_tokens") > 0))
    sums = used.groupBy(*by).agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    cost = token_cost(F.col("prompt_tokens"), F.col("completion_tokens"))
    return sums.withColumn("cost", F.round(cost, digits)).withColumn("mean_cost", F.round(cost / F.col("n"), digits))


def strategy_stats(results: DataFrame) -> DataFrame:
    """Latency, results and score of each strategy; failed ones count as none."""
    return results.groupBy("strategy").agg(
        F.count("*").alias("queries"), F.round(F.sum(hundredths(F.col("latency_ms"))) / F.count("*") / 100, 6).alias("mean_ms"), F.round(F.sum(F.coalesce("n_results", F.lit(0))) / F.count("*"), 6).alias("mean_results")
    )


def strategy_query_stats(hits: DataFrame) -> DataFrame:
    """Hits, best and mean score of each strategy and query (``search_by_strategies``); scores are summed in millionths."""
    total = F.sum(F.round(F.col("score") * 1_000_000).cast("long"))
    return hits.groupBy("strategy", "query_id").agg(F.count("*").alias("n"), F.max("score").alias("top_score"), F.round(total / F.count("*") / 1_000_000, 6).alias("mean_score"))


def best_strategy(results: DataFrame, how: str = "best") -> DataFrame:
    """Fastest, with most results, or of best mean score; failed strategies do not take part, ties go by name.

    ``results``: strategy, latency_ms, n_results, mean_score, error.
    """
    order = {"fastest": F.asc("latency_ms"), "most_results": F.desc("n_results")}.get(how, F.desc("mean_score"))
    return results.where("error IS NULL").orderBy(order, "strategy").limit(1)


def cache_rate(log: DataFrame, hit: Column) -> DataFrame:
    """A24."""
    return log.agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses")).withColumn("hit_rate", F.round(F.expr("try_divide(hits, hits + misses)"), 6))
