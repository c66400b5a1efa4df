"""Vector search, re-ranking, fusion of ranked lists, and dedup that keeps the first.

Ranked results carry ``rank``; every order has a total tiebreak. A search's
query side is broadcast only by Spark's own size check or after ``first`` has
made it a single row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslode.functions.keywords import counted, frequency_score, overlap, query_keywords, tokens, words_of
from corpuslode.functions.vectors import bounded_batches, cosine
from corpuslode.sources.files import workspace

TOP_K = 5
ALPHA = 0.7
RRF_K = 60
CUTOFF = 0.7
#: Vectors in a pack, and values of the packed queries up to which they are broadcast (64 MB).
PACK, BROADCAST_VALUES = 1024, 1 << 23
#: Terms of most documents, whose numbers of documents are broadcast.
FREQUENT = 50_000


def ranked(df: DataFrame, score: str = "score", key: str = "node_id", by: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(key))
    return df.withColumn("rank", F.row_number().over(w))


def top(df: DataFrame, k: int, score: str = "score", key: str = "node_id", by: Sequence[str] = ()) -> DataFrame:
    """The k best rows with their rank: a top-k without groups never sorts more than k rows a task."""
    if not by:
        return ranked(df.orderBy(F.desc(score), F.asc(key)).limit(k), score, key)
    return ranked(df, score, key, by).where(F.col("rank") <= k)


def score_by_vector(nodes: DataFrame, vector: Sequence[float], column: str = "embedding", digits: int = 6) -> DataFrame:
    """Similarity of one query vector to all nodes: a projection."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return nodes.withColumn("score", F.round(cosine(F.col(column), q), digits))


def search(nodes: DataFrame, vector: Sequence[float], k: int = TOP_K, column: str = "embedding", key: str = "node_id") -> DataFrame:
    """The k most similar nodes."""
    return top(score_by_vector(nodes, vector, column), k, key=key)


def _packs(rows: DataFrame, id_col: str, vector_col: str, names: tuple[str, str], size: int) -> DataFrame:
    """Rows of ``size`` unit vectors: their ids and one array of all their values; vectors without length or of no size are left out."""
    kind = dict(rows.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, size):
                b = whole.slice(i, size)
                b = b.filter(pc.greater(pc.fill_null(pc.list_value_length(b.column(1)), 0), 0))
                lengths = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
                for n in np.unique(lengths):
                    part = b.filter(pa.array(lengths == n))
                    m = pc.cast(part.column(1).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
                    norm = np.sqrt((m * m).sum(axis=1))
                    ok = norm > 0
                    ids = part.column(0).filter(pa.array(ok))
                    m = (m[ok] / norm[ok, None]).ravel()
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([m])], list(names))

    return rows.select(id_col, vector_col).where(f"`{vector_col}` IS NOT NULL").mapInArrow(run, f"{names[0]} array<{kind}>, {names[1]} array<double>")


def search_many(nodes: DataFrame, queries: DataFrame, k: int = TOP_K, digits: int = 6) -> DataFrame:
    """For each query (query_id, vector) its k most similar nodes (node_id, embedding).

    Vectors are brought to unit length once and packed. The queries, a stated
    set, meet all nodes pack by pack: one matrix product and the k best of each
    query are what is left of a pair. The packed queries are broadcast only
    below ``BROADCAST_VALUES`` values. Vectors of another size, or without
    length, have no similarity.
    """
    bounded_batches(nodes.sparkSession)  # a row is a pack of each side
    kinds = dict(queries.dtypes)["query_id"], dict(nodes.dtypes)["node_id"]
    asked = _packs(queries, "query_id", "vector", ("q", "qm"), PACK)
    size = queries.agg(F.sum(F.size("vector"))).first()[0] or 0
    asked = F.broadcast(asked) if size <= BROADCAST_VALUES else asked

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n, nm, q, qm = (b.column(c)[i].values for c in range(4))
                if not len(n) or len(nm) * len(q) != len(qm) * len(n):
                    continue
                x, y = nm.to_numpy().reshape(len(n), -1), qm.to_numpy().reshape(len(q), -1)
                s = np.floor((y @ x.T) * 10.0**digits + 0.5) / 10.0**digits
                place = pc.rank(n, tiebreaker="first").to_numpy()
                order = np.stack([np.lexsort((place, -row))[:k] for row in s])
                of = np.repeat(np.arange(len(q)), order.shape[1])
                yield pa.RecordBatch.from_arrays([q.take(pa.array(of)), n.take(pa.array(order.ravel())), pa.array(s[of, order.ravel()])], ["query_id", "node_id", "score"])

    met = _packs(nodes, "node_id", "embedding", ("n", "nm"), PACK).crossJoin(asked)  # of packs
    pairs = met.mapInArrow(best, f"query_id {kinds[0]}, node_id {kinds[1]}, score double")
    return top(pairs.select("query_id", "node_id", F.round("score", digits).alias("score")), k, by=["query_id"])


def search_by_strategies(parts: dict[str, DataFrame], strategies: dict[str, Sequence[str]], queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best nodes of each query under each strategy, in one plan: strategy, query_id, node_id, score, rank.

    ``parts``: disjoint sets of nodes (node_id, embedding). A strategy searches
    some of them. Each node is scored once for a query, however many strategies
    search it: a strategy's best are among the k best of each of its parts.
    """
    found = None
    for name, nodes in parts.items():
        of = F.array(*[F.lit(s) for s, names in strategies.items() if name in names]).cast("array<string>")
        hits = search_many(nodes, queries, k).select(of.alias("of"), "query_id", "node_id", "score")
        found = hits if found is None else found.unionByName(hits)
    return top(found.select(F.explode("of").alias("strategy"), "query_id", "node_id", "score"), k, by=["strategy", "query_id"])


def in_windows(hits: DataFrame) -> DataFrame:
    """Hits with the text of their window, where they have one, in place of their own."""
    return hits.withColumn("text", F.coalesce("window_text", "text")).drop("window_text")


def cutoff(df: DataFrame, least: float = CUTOFF) -> DataFrame:
    """F21."""
    return df.where(F.col("score") >= least)


# ------------------------------------------------------------------ keywords


def postings(docs: DataFrame, key: str = "node_id", text: str = "text") -> DataFrame:
    """Term, key and weight = tf * ln(N / (df + 1)), tf by the document's number of tokens.

    A document's terms are counted in its row. How many documents have each term
    is kept in a table; the ``FREQUENT`` terms of most documents, which have most
    of the postings, are broadcast, and only postings of other terms are shuffled.
    """
    spark = docs.sparkSession
    words = docs.select(F.col(key), tokens(F.col(text)).alias("t"))
    path = workspace(spark, "terms")
    words.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.parquet(path)
    known = spark.read.schema("term string, df long").parquet(path)
    frequent = known.orderBy(F.desc("df"), "term").limit(FREQUENT)
    tf = words.select(key, F.size("t").alias("n"), F.explode(counted(F.col("t"))).alias("x")).select("x.term", key, "n", "x.c")
    rest = tf.join(F.broadcast(frequent.select("term")), "term", "left_anti").join(known, "term")
    total = docs.agg(F.count("*").alias("total"))  # one row
    joined = tf.join(F.broadcast(frequent), "term").unionByName(rest).crossJoin(F.broadcast(total))
    return joined.select("term", key, (F.col("c") / F.col("n") * F.log(F.col("total") / (F.col("df") + 1))).alias("weight"))


def keyword_search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "node_id", digits: int = 8) -> DataFrame:
    """For each query (query_id, query) the k documents of largest summed weight, once per occurrence of a token.

    Only postings of the queries' terms are built: the terms are semi-joined
    before anything is counted by term.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term"))
    asked = asked.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    words = docs.select(key, tokens(F.col("text")).alias("t")).withColumn("n", F.size("t"))
    terms = asked.select("term").distinct()
    tf = words.select(key, "n", F.explode("t").alias("term")).join(terms, "term", "left_semi").groupBy("term", key, "n").agg(F.count("*").alias("c"))
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("total"))
    weights = tf.join(df_, "term").crossJoin(F.broadcast(total)).select("term", key, (F.col("c") / F.col("n") * F.log(F.col("total") / (F.col("df") + 1))).alias("weight"))
    scores = asked.join(weights, "term").groupBy("query_id", key).agg(F.round(F.sum(F.col("times") * F.col("weight")), digits).alias("score"))
    return top(scores, k, key=key, by=["query_id"])


# -------------------------------------------------------------------- fusion
# Ranked lists are one DataFrame: list (its name), node_id, score, rank.


def rrf(lists: DataFrame, k: int = RRF_K, digits: int = 9) -> DataFrame:
    """R8."""
    return lists.groupBy("node_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), digits).alias("score"))


def weighted(lists: DataFrame, weights: dict[str, float], digits: int = 9) -> DataFrame:
    """A list without a weight is left out."""
    w = F.coalesce(*[F.when(F.col("list") == name, F.lit(float(x))) for name, x in weights.items()])
    return lists.withColumn("w", w).where("w IS NOT NULL").groupBy("node_id").agg(F.round(F.sum(F.col("w") * F.col("score")), digits).alias("score"))


def borda(lists: DataFrame) -> DataFrame:
    """The length of the list less the rank counted from zero."""
    length = F.max("rank").over(Window.partitionBy("list"))
    return lists.withColumn("points", length - F.col("rank") + 1).groupBy("node_id").agg(F.sum("points").cast("double").alias("score"))


def inverse_rank(lists: DataFrame, digits: int = 9) -> DataFrame:
    """R9."""
    return lists.groupBy("node_id").agg(F.round(F.sum(1 / F.col("rank")), digits).alias("score"))


def fuse(lists: DataFrame, method: str = "rrf", k: int = TOP_K, weights: dict[str, float] | None = None) -> DataFrame:
    """Unknown methods are rrf."""
    found = {"weighted": lambda: weighted(lists, weights or {}), "borda": lambda: borda(lists), "inverse_rank": lambda: inverse_rank(lists)}.get(method, lambda: rrf(lists))()
    return top(found, k)


def union_of_queries(hits: DataFrame, k: int = TOP_K) -> DataFrame:
    """What several sub-queries found (node_id, score), each node once with its best score, cut to the k best of all."""
    return top(hits.groupBy("node_id").agg(F.max("score").alias("score")), k)


def overlaps(lists: DataFrame) -> DataFrame:
    """Of each pair of lists the number of nodes in both."""
    a, b = lists.select(F.col("list").alias("list_a"), "node_id"), lists.select(F.col("list").alias("list_b"), "node_id")
    return a.join(b, "node_id").where("list_a < list_b").groupBy("list_a", "list_b").agg(F.count("*").alias("both"))


def list_stats(lists: DataFrame, digits: int = 6) -> DataFrame:
    """Number, mean and largest score of each list."""
    return lists.groupBy("list").agg(F.count("*").alias("n"), F.round(F.avg("score"), digits).alias("mean_score"), F.max("score").alias("max_score"))


# ----------------------------------------------------------------- re-ranking


def blend(vector: Column, keyword: Column, alpha: float = ALPHA) -> Column:
    """J9."""
    return alpha * vector + (1 - alpha) * keyword


def hybrid_rerank(hits: DataFrame, query: Column, k: int = TOP_K, digits: int = 6) -> DataFrame:
    """Hits (node_id, text, score), twice as many as wanted, by vector and keyword score."""
    keyword = frequency_score(F.col("text"), query_keywords(query))
    return top(hits.withColumn("score", F.round(blend(F.col("score"), keyword), digits)), k)


def lexical_rerank(hits: DataFrame, query: Column, share: float = 0.3, digits: int = 6) -> DataFrame:
    """R16."""
    return hits.withColumn("score", F.round((1 - share) * F.col("score") + share * overlap(query, F.col("text")), digits))


def lexical_topk(docs: DataFrame, queries: DataFrame, k: int = 20, base: float = 1.0, share: float = 0.3, key: str = "node_id", digits: int = 6) -> DataFrame:
    """R16 over a whole table: for each query (query_id, query) the k documents of largest blend of ``base`` and lexical overlap.

    The queries' words meet the documents that hold them; a query that fewer
    than k documents share a word with is filled up with the first other ones.
    """
    asked = queries.select("query_id", words_of(F.col("query")).alias("q"))
    terms = asked.select("query_id", F.size("q").alias("n"), F.explode("q").alias("w"))
    held = docs.select(key, F.explode(words_of(F.col("text"))).alias("w")).join(terms.select("w").distinct(), "w", "left_semi")
    score = lambda part: F.round((1 - share) * base + share * part, digits)
    met = terms.join(held, "w").groupBy("query_id", key, "n").agg(F.count("*").alias("c")).select("query_id", key, score(F.col("c") / F.col("n")).alias("score"))
    # per query at most k documents without a common word can be wanted, and they are among the first 2k of all that share none
    best = top(met, k, key=key, by=["query_id"])
    fill = docs.select(key).orderBy(key).limit(2 * k).crossJoin(asked.select("query_id"))  # 2k rows beside a stated set
    fill = fill.join(met.select("query_id", key), ["query_id", key], "left_anti").select("query_id", key, score(F.lit(0.0)).alias("score"))
    return top(best.select("query_id", key, "score").union(fill), k, key=key, by=["query_id"])


def section_rank(hits: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """By the place of the section among those preferred (key_info first, others last), then by score."""
    place = F.when(F.col("section") == "key_info", 0)
    for i, s in enumerate(preferred):
        place = place.when(F.col("section") == s, i)
    priority = place.otherwise(len(preferred))
    w = Window.orderBy("priority", F.desc("score"), "node_id")
    return hits.withColumn("priority", priority).withColumn("rank", F.row_number().over(w))


def by_section(nodes: DataFrame, vector: Sequence[float], preferred: Sequence[str], k: int = TOP_K) -> DataFrame:
    """Search in the preferred sections; where they hold too few, in all, and keep those preferred."""
    hits = search(nodes.where(F.col("section").isin(*preferred)), vector, k)
    if hits.count() < k // 2:
        hits = search(nodes, vector, 2 * k).where(F.col("section").isin(*preferred))
    return section_rank(hits.drop("rank"), preferred).where(F.col("rank") <= k)


# -------------------------------------------------------- merging and dedup


def keep_first(df: DataFrame, key: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """Of rows equal in ``key`` the first in ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def interleave(a: DataFrame, b: DataFrame) -> DataFrame:
    """First of a, first of b, second of a, and so on; each node once."""
    both = a.withColumn("list_no", F.lit(0)).unionByName(b.withColumn("list_no", F.lit(1)))
    return keep_first(both, ["node_id"], ["rank", "list_no"]).withColumn("place", F.row_number().over(Window.orderBy("rank", "list_no")))


def concatenate(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """A, then b, each node once, the first k."""
    both = a.withColumn("list_no", F.lit(0)).unionByName(b.withColumn("list_no", F.lit(1)))
    once = keep_first(both, ["node_id"], ["list_no", "rank"]).orderBy("list_no", "rank").limit(k)
    return once.withColumn("place", F.row_number().over(Window.orderBy("list_no", "rank")))


# --------------------------------------------------------------------- joins


def per_group(nodes: DataFrame, groups: DataFrame, n: int, group: str = "doc_id") -> DataFrame:
    """Of each selected group its n best nodes; the groups are a join, so Spark broadcasts them while they are small."""
    return top(nodes.join(groups, group), n, by=[group])


def candidates_only(df: DataFrame, candidates: DataFrame, key: str = "node_id") -> DataFrame:
    """J3, J6."""
    return df.join(candidates.select(key).distinct(), key, "left_semi")


def neighbours(hits: DataFrame, nodes: DataFrame, group: str, key: str = "node_id") -> DataFrame:
    """Other nodes of the hits' groups."""
    wanted = nodes.join(hits.select(group).distinct(), group, "left_semi")
    return wanted.join(hits.select(key), key, "left_anti")
