"""A stored vector index: unit vectors by cluster with centre and radius, and exact top-k that leaves clusters shut.

``write`` takes a bounded number of vectors, chosen by a hash, as first centres,
moves each to the mean of those of the sample nearest to it a few times, and
deals every vector to its nearest centre. A cluster's radius is the angle to its
farthest vector. A vector of cluster c is at an angle of at least ``angle(query,
c) - radius`` to a query, which bounds its similarity. ``search`` opens the
clusters of largest bound for each query, and then only those whose bound
reaches the k-th similarity found: nothing is lost. Clusters are cut into parts
of ``PART_ROWS`` rows, so that one that holds a third of all vectors is the work
of many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslode.functions.vectors import bounded_batches
from corpuslode.operators.ranking import PACK, TOP_K, top

#: Vectors that centres are fitted on at most, centres at most, and moves of the centres.
SAMPLE_ROWS, MOST_CENTRES, MOVES = 20_000, 1024, 4
PART_ROWS = 4096
#: Queries that meet a part in one product, and bounds of a batch.
STEP, BOUNDS = 256, 8192
#: Clusters opened for a query before there is a similarity to reach.
FIRST_CLUSTERS = 2
#: Radians that a bound is wider, for vectors kept in single precision.
SLACK = 1e-5


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the largest size, and which rows have one; null vectors, those of no length and of another size have none."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    size = int(lengths.max(initial=0))
    ok = (lengths == size) & (size > 0)
    m = pc.cast(column.filter(pa.array(ok)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, max(size, 1))
    norm = np.sqrt((m * m).sum(axis=1))
    ok[np.flatnonzero(ok)[norm == 0]] = False
    return m[norm > 0] / norm[norm > 0, None], ok


def centres(nodes: DataFrame, column: str = "embedding", most: int = MOST_CENTRES) -> np.ndarray:
    """Centres of length one, as many as the root of the number of vectors, fitted on a bounded sample."""
    nodes = nodes.where(F.col(column).isNotNull())
    n = nodes.count()
    sample = nodes.select(column) if n <= SAMPLE_ROWS else nodes.where(F.pmod(F.xxhash64(column), F.lit(1 << 32)) < F.lit((1 << 32) * SAMPLE_ROWS // n)).select(column)
    x, _ = _unit(sample.orderBy(F.xxhash64(column)).limit(SAMPLE_ROWS).toArrow().column(0).combine_chunks())
    x = np.unique(x, axis=0)
    if not len(x):
        return np.zeros((0, 1))
    x = x[np.random.default_rng(7).permutation(len(x))]
    c = x[: max(1, min(most, int(n**0.5), len(x)))]
    for _ in range(MOVES):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], c)
    return c


def write(nodes: DataFrame, path: str, key: str = "node_id", column: str = "embedding", most: int = MOST_CENTRES) -> None:
    """Write the index: ``vectors`` (cluster, part, ids and one array of their values), ``clusters`` (centre, radius, vectors).

    Vectors without length, null ones, and those of another size than the first centre are not in it: they have no similarity.
    """
    spark = nodes.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(centres(nodes, column, most))  # at most ``most`` vectors
    kind = dict(nodes.dtypes)[key]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            x, ok = _unit(b.column("v"))
            if not len(x) or x.shape[1] != c.shape[1]:
                continue
            s = x @ c.T
            at = s.argmax(axis=1)
            angle = np.arccos(np.clip(s[np.arange(len(x)), at], -1, 1))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(ok)), pa.array(at.astype(np.int32)), pa.array(angle), values], ["id", "cluster", "angle", "v"])

    dealt = nodes.select(F.col(key).alias("id"), F.col(column).alias("v")).mapInArrow(near, f"id {kind}, cluster int, angle double, v array<double>")
    # a row for each cluster; parts of a large one are told apart by a hash of the vector and id
    sizes = dealt.groupBy("cluster").agg(F.count("*").alias("rows"), F.max("angle").alias("radius"))
    known = {r["cluster"]: r for r in sizes.collect()}
    parts = F.element_at(F.create_map(*[F.lit(x) for c, r in known.items() for x in (c, -(-r["rows"] // PART_ROWS))]), F.col("cluster")) if known else F.lit(1)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", "v"), parts.cast("long")).cast("int"))
    packed = dealt.groupBy("cluster", "part").agg(F.collect_list(F.struct("id", "v")).alias("p"))
    packed.select("cluster", "part", F.col("p.id").alias("ids"), F.flatten("p.v").alias("values")).write.partitionBy("cluster").parquet(f"{path}/vectors")
    spark.range(1).select(F.lit(kind).alias("kind")).write.parquet(f"{path}/kind")
    rows = [(c, shared.value[c].tolist(), r["radius"], r["rows"]) for c, r in sorted(known.items())]
    spark.createDataFrame(rows, "cluster int, centre array<double>, radius double, rows long").coalesce(1).write.parquet(f"{path}/clusters")


def _bounds(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """The largest similarity that each cluster can have for each query; the clusters are at most ``MOST_CENTRES`` rows."""
    stored = spark.read.parquet(f"{path}/clusters").collect()
    table = [r["cluster"] for r in stored], np.array([r["centre"] for r in stored]), np.array([r["radius"] for r in stored])
    shared = spark.sparkContext.broadcast(table)
    kind = dict(queries.dtypes)["query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c, radius = shared.value
        for b in batches:
            x, ok = _unit(b.column("vector"))
            if not len(x) or not len(ids) or x.shape[1] != c.shape[1]:
                continue
            asked = b.column("query_id").filter(pa.array(ok))
            step = max(1, BOUNDS // len(ids))
            for i in range(0, len(x), step):
                y = x[i : i + step]
                angle = np.arccos(np.clip(y @ c.T, -1, 1)) - radius - SLACK
                bound = np.cos(np.clip(angle, 0, np.pi))
                of = pa.array(np.repeat(np.arange(len(y)), len(ids)))
                q = pa.array(y.tolist()).take(of)
                yield pa.RecordBatch.from_arrays([asked.slice(i, len(y)).take(of), q, pa.array(np.tile(np.array(ids, np.int32), len(y))), pa.array(bound.ravel())], ["query_id", "q", "cluster", "bound"])

    return queries.select("query_id", "vector").mapInArrow(run, f"query_id {kind}, q array<double>, cluster int, bound double")


def _packs(queries: DataFrame) -> int:
    return max(1, -(-queries.count() // PACK))


def _opened(spark: SparkSession, path: str, chosen: DataFrame, k: int, digits: int, packs: int) -> DataFrame:
    """The k best of the chosen clusters (query_id, q, cluster), for each query and part.

    A part meets the queries of its cluster pack by pack, so no row holds all queries.
    """
    kind = spark.read.parquet(f"{path}/kind").first()["kind"]
    # an index of no vectors has no file that tells their schema
    stored = spark.read.schema(f"part int, ids array<{kind}>, values array<double>, cluster int").parquet(f"{path}/vectors")
    # clusters that no query opens are folders that no task reads
    wanted = [r[0] for r in chosen.select("cluster").distinct().collect()]
    kinds = dict(chosen.dtypes)["query_id"], kind
    chosen = chosen.withColumn("pack", F.pmod(F.xxhash64("query_id"), F.lit(packs)))
    asked = chosen.groupBy("cluster", "pack").agg(F.collect_list("query_id").alias("qs"), F.flatten(F.collect_list("q")).alias("qv"))
    met = stored.where(F.col("cluster").isin(wanted)).join(asked, "cluster").select("ids", "values", "qs", "qv")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n, v, q, qv = (b.column(c)[i].values for c in range(4))
                x, y = v.to_numpy().reshape(len(n), -1), qv.to_numpy().reshape(len(q), -1)
                place = pc.rank(n, tiebreaker="first").to_numpy()
                for j in range(0, len(y), STEP):
                    s = np.floor((y[j : j + STEP] @ x.T) * 10.0**digits + 0.5) / 10.0**digits
                    order = np.stack([np.lexsort((place, -row))[:k] for row in s])
                    of = np.repeat(np.arange(len(s)), order.shape[1])
                    yield pa.RecordBatch.from_arrays([q.take(pa.array(of + j)), n.take(pa.array(order.ravel())), pa.array(s[of, order.ravel()])], ["query_id", "node_id", "score"])

    return met.mapInArrow(best, f"query_id {kinds[0]}, node_id {kinds[1]}, score double")


def choose(spark: SparkSession, path: str, queries: DataFrame, k: int = TOP_K, digits: int = 6) -> DataFrame:
    """All pairs of a query and a cluster, with open: whether a search opens it."""
    bounded_batches(spark)
    bounds = _bounds(spark, path, queries)
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cluster")
    numbered = bounds.withColumn("i", F.row_number().over(order))
    first = _opened(spark, path, numbered.where(F.col("i") <= FIRST_CLUSTERS), k, digits, _packs(queries))
    reached = top(first, k, by=["query_id"]).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    # a similarity is rounded, so a bound half a unit below may reach it
    return numbered.join(reached, "query_id", "left").withColumn("open", F.expr(f"least IS NULL OR bound + {0.5 * 10.0**-digits} >= least"))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = TOP_K, digits: int = 6) -> DataFrame:
    """For each query (query_id, vector) its k most similar nodes, as ``ranking.search_many`` finds them."""
    return top(_opened(spark, path, choose(spark, path, queries, k, digits).where("open"), k, digits, _packs(queries)), k, by=["query_id"])


def opened(spark: SparkSession, path: str, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """Of each query the clusters there are, and those that a search opens."""
    return choose(spark, path, queries, k).groupBy("query_id").agg(F.count("*").alias("clusters"), F.count_if("open").alias("opened"))
