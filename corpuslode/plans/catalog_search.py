"""Queries on vectors and ranked lists, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslode.functions.keywords import STOP_WORDS, frequency_score, query_keywords
from corpuslode.functions.vectors import embedder
from corpuslode.operators import ranking as R
from corpuslode.operators import stats as A
from corpuslode.operators.filters import by_values
from corpuslode.operators.chunking import longest_chunk, row_windows
from corpuslode.operators.metadata import embedding_rows, preview, tagged
from corpuslode.plans.control import round_robin as take_turns
from corpuslode.plans.control import union_strategies
from corpuslode.registry import query, table

QUESTION = "compare the ndonou reports of heatnd and the onre area"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", "label")


def vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One stated row: the query vector."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


def hits(spark: SparkSession, sf_dir: str, vec_id: int, k: int = 10) -> DataFrame:
    return R.search(nodes(spark, sf_dir), vector(spark, sf_dir, vec_id), k)


def lists(spark: SparkSession, sf_dir: str, n: int = 2, k: int = 10) -> DataFrame:
    """The k best nodes for each of the first n vectors, by one pass over the nodes."""
    asked = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < n).select(F.concat(F.lit("list"), F.col("vec_id").cast("string")).alias("query_id"), F.col("embedding").alias("vector"))
    return R.search_many(nodes(spark, sf_dir), asked, k).withColumnRenamed("query_id", "list")


def sim(i: int, where: str = "true") -> str:
    return f"""(SELECT vec_id AS node_id, label, round(list_cosine_similarity(embedding::DOUBLE[],
      (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {i})), 6) AS score FROM embeddings WHERE {where})"""


def top(i: int, k: int, where: str = "true") -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY score DESC, node_id)::INT AS rank FROM {sim(i, where)} QUALIFY rank <= {k})"


def lists_sql(n: int = 2, k: int = 10) -> str:
    return "(" + " UNION ALL ".join(f"SELECT 'list{i}' AS list, node_id, score, rank FROM {top(i, k)}" for i in range(n)) + ")"


@query("r1_vector_topk", f"SELECT node_id, score, rank FROM {top(0, 5)}")
def vector_topk(spark, sf_dir):
    return hits(spark, sf_dir, 0, 5).select("node_id", "score", "rank")


@query("f2_vector_topk_filtered", f"SELECT node_id, label, score, rank FROM {top(0, 5, 'label IN (1, 2, 3)')}")
def vector_topk_filtered(spark, sf_dir):
    return R.search(by_values(nodes(spark, sf_dir), "label", [1, 2, 3]), vector(spark, sf_dir, 0), 5).drop("embedding")


@query("f8_filter_behind_topk", f"SELECT node_id, label, score, rank FROM {top(0, 20)} WHERE label IN (1, 2, 3)")
def filter_behind_topk(spark, sf_dir):
    return by_values(hits(spark, sf_dir, 0, 20), "label", [1, 2, 3]).drop("embedding")


@query("f21_similarity_cutoff", f"SELECT node_id, score FROM {sim(0)} WHERE score >= 0.1")
def similarity_cutoff(spark, sf_dir):
    return R.cutoff(R.score_by_vector(nodes(spark, sf_dir), vector(spark, sf_dir, 0)), 0.1).select("node_id", "score")


@query("j2_topk_per_group", f"SELECT node_id, label, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, node_id)::INT AS rank FROM {sim(0)} QUALIFY rank <= 3")
def topk_per_group(spark, sf_dir):
    return R.top(R.score_by_vector(nodes(spark, sf_dir), vector(spark, sf_dir, 0)), 3, by=["label"]).drop("embedding")


@query(
    "r26_batch_topk",
    """
    WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS node_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
               FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)
    SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INT AS rank FROM s QUALIFY rank <= 5
    """,
)
def batch_topk(spark, sf_dir):
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.search_many(nodes(spark, sf_dir), asked)


CENTROIDS = """c AS (SELECT label, list(m ORDER BY i) AS centre FROM (
        SELECT label, i, round(avg(x), 9) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"""


def centroids(spark, sf_dir) -> DataFrame:
    """A summary vector for each label: the mean of each dimension."""
    flat = nodes(spark, sf_dir).select("label", F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))


@query(
    "j4_two_level",
    f"""
    WITH {CENTROIDS},
    q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
    g AS (SELECT label, round(list_cosine_similarity(centre, q), 6) AS group_score, row_number() OVER (ORDER BY group_score DESC, label) AS gr FROM c, q QUALIFY gr <= 5),
    s AS (SELECT vec_id AS node_id, label, group_score, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings JOIN g USING (label), q)
    SELECT node_id, label, group_score, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, node_id)::INT AS rank FROM s QUALIFY rank <= 15
    """,
)
def two_level(spark, sf_dir):
    q = vector(spark, sf_dir, 0)
    groups = R.score_by_vector(centroids(spark, sf_dir), q, "centre").orderBy(F.desc("score"), "label").limit(5)
    groups = groups.select("label", F.col("score").alias("group_score"))
    return R.per_group(R.score_by_vector(nodes(spark, sf_dir), q), groups, 15, "label").drop("embedding")


@query(
    "z53_two_level_small",
    f"""
    WITH {CENTROIDS},
    q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
    g AS (SELECT label, row_number() OVER (ORDER BY round(list_cosine_similarity(centre, q), 6) DESC, label) AS gr FROM c, q QUALIFY gr <= 2),
    s AS (SELECT vec_id AS node_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings JOIN g USING (label), q)
    SELECT node_id, label, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, node_id)::INT AS rank FROM s QUALIFY rank <= 3
    """,
)
def two_level_small(spark, sf_dir):
    q = vector(spark, sf_dir, 0)
    groups = R.score_by_vector(centroids(spark, sf_dir), q, "centre").orderBy(F.desc("score"), "label").limit(2).select("label")
    return R.per_group(R.score_by_vector(nodes(spark, sf_dir), q), groups, 3, "label").drop("embedding")


@query(
    "k1_nearest_description",
    f"""
    WITH {CENTROIDS},
    s AS (SELECT vec_id AS node_id, e.label, c.label AS predicted, round(list_cosine_similarity(embedding::DOUBLE[], centre), 6) AS score FROM embeddings e, c)
    SELECT node_id, label, predicted, score FROM s QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY score DESC, predicted) = 1
    """,
)
def nearest_description(spark, sf_dir):
    # the rows ask, the descriptions are searched
    c = centroids(spark, sf_dir).select(F.col("label").alias("node_id"), F.col("centre").alias("embedding"))
    n = nodes(spark, sf_dir)
    best = R.search_many(c, n.select(F.col("node_id").alias("query_id"), F.col("embedding").alias("vector")), 1)
    best = best.select(F.col("query_id").alias("node_id"), F.col("node_id").alias("predicted"), "score")
    return n.select("node_id", "label").join(best, "node_id")


@query("r8_rrf", f"SELECT *, row_number() OVER (ORDER BY score DESC, node_id)::INT AS rank FROM (SELECT node_id, round(sum(1 / (60 + rank)), 9) AS score FROM {lists_sql()} GROUP BY node_id)")
def rrf(spark, sf_dir):
    return R.fuse(lists(spark, sf_dir), "rrf", 1000)


@query("j10_weighted_fusion", f"SELECT node_id, round(sum(score * CASE list WHEN 'list0' THEN 0.7 ELSE 0.3 END), 9) AS score FROM {lists_sql()} GROUP BY node_id")
def weighted_fusion(spark, sf_dir):
    return R.weighted(lists(spark, sf_dir), {"list0": 0.7, "list1": 0.3})


@query("r9_borda", f"SELECT node_id, sum(11 - rank)::DOUBLE AS score FROM {lists_sql()} GROUP BY node_id")
def borda(spark, sf_dir):
    return R.borda(lists(spark, sf_dir))


@query("r9_inverse_rank", f"SELECT node_id, round(sum(1 / rank), 9) AS score FROM {lists_sql()} GROUP BY node_id")
def inverse_rank(spark, sf_dir):
    return R.inverse_rank(lists(spark, sf_dir))


@query("r10_hybrid", f"SELECT *, row_number() OVER (ORDER BY score DESC, node_id)::INT AS rank FROM (SELECT node_id, round(sum(1 / (60 + rank)), 9) AS score FROM {lists_sql()} GROUP BY node_id) QUALIFY rank <= 5")
def hybrid(spark, sf_dir):
    return R.fuse(lists(spark, sf_dir), "unknown")


@query(
    "r11_ensemble",
    f"""
    WITH w(list, w) AS (VALUES ('list0', 0.3), ('list1', 0.25), ('list2', 0.2), ('list4', 0.1))
    SELECT *, row_number() OVER (ORDER BY score DESC, node_id)::INT AS rank FROM (SELECT node_id, round(sum(score * w), 9) AS score FROM {lists_sql(5, 15)} JOIN w USING (list) GROUP BY node_id) QUALIFY rank <= 10
    """,
)
def ensemble(spark, sf_dir):
    return R.top(R.weighted(lists(spark, sf_dir, 5, 15), {"list0": 0.3, "list1": 0.25, "list2": 0.2, "list4": 0.1}), 10)


@query("r12_list_overlap", f"WITH l AS MATERIALIZED (SELECT list, node_id FROM {lists_sql(4, 30)}) SELECT a.list AS list_a, b.list AS list_b, count(*) AS both FROM l a JOIN l b ON a.node_id = b.node_id WHERE a.list < b.list GROUP BY ALL")
def list_overlap(spark, sf_dir):
    return R.overlaps(lists(spark, sf_dir, 4, 30))


@query("r12_list_stats", f"SELECT list, count(*) AS n, round(avg(score), 6) AS mean_score, max(score) AS max_score FROM {lists_sql(4, 30)} GROUP BY list")
def list_stats(spark, sf_dir):
    return R.list_stats(lists(spark, sf_dir, 4, 30))


PRIORITY = "CASE label WHEN 0 THEN 0 WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END"


def sectioned(spark, sf_dir, k: int) -> DataFrame:
    section = F.when(F.col("label") == 0, "key_info").otherwise(F.concat(F.lit("s"), F.col("label").cast("string")))
    return hits(spark, sf_dir, 0, k).drop("rank", "embedding").withColumn("section", section)


@query("r17_section_rank", f"SELECT node_id, label, score, {PRIORITY} AS priority, row_number() OVER (ORDER BY {PRIORITY}, score DESC, node_id)::INT AS rank FROM {top(0, 50)}")
def section_rank(spark, sf_dir):
    return R.section_rank(sectioned(spark, sf_dir, 50), ["s3", "s1"]).drop("section")


@query("r18_by_section", f"SELECT node_id, score, CASE label WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS priority, row_number() OVER (ORDER BY CASE label WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 2 END, score DESC, node_id)::INT AS rank FROM {top(0, 5, 'label IN (0, 1, 3)')}")
def by_section(spark, sf_dir):
    section = F.when(F.col("label") == 0, "key_info").otherwise(F.concat(F.lit("s"), F.col("label").cast("string")))
    n = nodes(spark, sf_dir).withColumn("section", section)
    return R.by_section(n, vector(spark, sf_dir, 0), ["key_info", "s3", "s1"]).select("node_id", "score", "priority", "rank")


@query(
    "r20_chunks_then_context",
    f"""
    WITH u AS (SELECT 0 AS l, node_id, score, rank FROM {top(0, 10)} UNION ALL SELECT 1, node_id, score, rank FROM {top(1, 5)}),
    o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY l, rank) = 1)
    SELECT node_id, score, row_number() OVER (ORDER BY l, rank)::INT AS place FROM o QUALIFY place <= 12
    """,
)
def chunks_then_context(spark, sf_dir):
    a, b = (hits(spark, sf_dir, i, k).select("node_id", "score", "rank") for i, k in ((0, 10), (1, 5)))
    return R.concatenate(a, b, 12).select("node_id", "score", "place")


@query(
    "r21_interleave",
    f"""
    WITH u AS (SELECT 0 AS l, node_id, score, rank FROM {top(0, 10)} UNION ALL SELECT 1, node_id, score, rank FROM {top(1, 10)}),
    o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY rank, l) = 1)
    SELECT node_id, score, row_number() OVER (ORDER BY rank, l)::INT AS place FROM o
    """,
)
def interleave(spark, sf_dir):
    a, b = (hits(spark, sf_dir, i).select("node_id", "score", "rank") for i in (0, 1))
    return R.interleave(a, b).select("node_id", "score", "place")


@query("d3_union_of_types", "SELECT label % 3 AS type, count(*) AS n, count(DISTINCT vec_id) AS ids FROM embeddings GROUP BY ALL")
def union_of_types(spark, sf_dir):
    n = nodes(spark, sf_dir)
    parts = [n.where(F.col("label") % 3 == i).withColumn("type", F.lit(i)) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("node_id").alias("ids"))


@query("j6_candidate_semijoin", f"SELECT node_id, score FROM {sim(0)} WHERE node_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def candidate_semijoin(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("node_id"))
    return R.candidates_only(R.score_by_vector(nodes(spark, sf_dir), vector(spark, sf_dir, 0)), good).select("node_id", "score")


@query(
    "j7_neighbour_expansion",
    f"""
    WITH h AS (SELECT node_id, label FROM {top(0, 3)})
    SELECT vec_id AS node_id, label FROM embeddings WHERE label IN (SELECT label FROM h) AND vec_id NOT IN (SELECT node_id FROM h)
    """,
)
def neighbour_expansion(spark, sf_dir):
    h = hits(spark, sf_dir, 0, 3)
    return R.neighbours(h, nodes(spark, sf_dir), "label").select("node_id", "label")


KEYWORDS_SQL = "['area', 'compare', 'heatnd', 'ndonou', 'onre', 'reports', 'the', 'and']"


@query(
    "r13_hybrid_rerank",
    f"""
    WITH h AS (SELECT node_id, t.text, score FROM {top(0, 10)} JOIN documents t ON t.doc_id = node_id),
    k AS (SELECT node_id, score, least(list_sum(list_transform({KEYWORDS_SQL}, lambda w: (length(lower(text)) - length(replace(lower(text), w, ''))) / length(w) * 0.1)) / 8, 1.0) AS kw FROM h),
    b AS (SELECT node_id, round(0.7 * score + (1 - 0.7) * kw, 6) AS score FROM k)
    SELECT *, row_number() OVER (ORDER BY score DESC, node_id)::INT AS rank FROM b QUALIFY rank <= 5
    """,
)
def hybrid_rerank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")
    found = hits(spark, sf_dir, 0, 10).select("node_id", "score").join(docs, "node_id")
    return R.hybrid_rerank(found, F.lit(QUESTION)).drop("text")


@query(
    "r16_lexical_rerank",
    """
    WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS q FROM benchmark WHERE item_id % 50 = 0),
    d AS (SELECT doc_id AS node_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS d FROM documents),
    s AS (SELECT query_id, node_id, round(0.7 + 0.3 * coalesce(len(list_intersect(q, d)) / nullif(len(q), 0), 0), 6) AS score FROM q, d)
    SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INT AS rank FROM s QUALIFY rank <= 20
    """,
)
def lexical_rerank(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")
    return R.lexical_topk(docs, asked)


TOKENS = r"list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3 AND NOT list_contains({stop}, w))"
TOKENS = TOKENS.format(stop="string_split('" + " ".join(STOP_WORDS) + "', ' ')")
WEIGHTS_SQL = f"""
    d AS (SELECT doc_id AS node_id, {TOKENS} AS t FROM documents),
    tf AS (SELECT node_id, len(t) AS n, unnest(t) AS term FROM d),
    c AS (SELECT term, node_id, count(*) / any_value(n) AS tf FROM tf GROUP BY term, node_id),
    f AS (SELECT term, ln((SELECT count(*) FROM documents) / (count(*) + 1)) AS idf FROM c GROUP BY term)"""


@query("r5_postings", f"WITH {WEIGHTS_SQL} SELECT term, node_id, round(tf * idf, 8) AS weight FROM c JOIN f USING (term)")
def postings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")
    return R.postings(docs).withColumn("weight", F.round("weight", 8))


@query(
    "r6_keyword_topk",
    f"""
    WITH {WEIGHTS_SQL},
    q AS (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark WHERE item_id % 50 = 0),
    s AS (SELECT query_id, node_id, round(sum(tf * idf), 8) AS score FROM q JOIN c USING (term) JOIN f USING (term) GROUP BY ALL)
    SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INT AS rank FROM s QUALIFY rank <= 10
    """,
)
def keyword_topk(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")
    return R.keyword_search(docs, asked)


@query("r14_frequency_score", f"SELECT doc_id, round(least(list_sum(list_transform({KEYWORDS_SQL}, lambda w: (length(lower(text)) - length(replace(lower(text), w, ''))) / length(w) * 0.1)) / 8, 1.0), 6) AS score FROM documents")
def frequency_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(frequency_score(F.col("text"), query_keywords(F.lit(QUESTION))), 6).alias("score"))


@query("p23_preview", f"SELECT node_id, score, rank, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview, 'vector' AS retrieval_strategy, 'documents' AS data_source FROM {top(0, 10)} JOIN documents ON doc_id = node_id")
def result_preview(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")
    found = hits(spark, sf_dir, 0, 10).select("node_id", "score", "rank").join(docs, "node_id")
    return tagged(preview(found), "vector", "documents").drop("text")


@query(
    "z30_all_strategies",
    f"""
    SELECT 'direct' AS strategy, node_id, score, rank FROM {top(0, 5)}
    UNION ALL SELECT 'filtered', node_id, score, rank FROM {top(0, 5, "label IN (1, 2)")}
    UNION ALL SELECT 'fused', node_id, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, node_id)::INT AS rank FROM (SELECT node_id, round(sum(1 / (60 + rank)), 9) AS score FROM {lists_sql()} GROUP BY node_id) QUALIFY rank <= 5)
    """,
)
def all_strategies(spark, sf_dir):
    pick = lambda df: df.select("node_id", "score", "rank")
    q = vector(spark, sf_dir, 0)
    return union_strategies({
        "direct": pick(hits(spark, sf_dir, 0, 5)), "filtered": pick(R.search(by_values(nodes(spark, sf_dir), "label", [1, 2]), q)), "fused": pick(R.fuse(lists(spark, sf_dir))),
    })


STRATEGIES = {"direct": ["first", "second", "rest"], "filtered": ["first", "second"], "section": ["first"]}


@query(
    "z32_strategies_by_query",
    """
    WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS node_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
    a AS (SELECT 'direct' AS strategy, * FROM s UNION ALL SELECT 'filtered', * FROM s WHERE label IN (1, 2) UNION ALL SELECT 'section', * FROM s WHERE label = 1),
    h AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY strategy, query_id ORDER BY score DESC, node_id) <= 5)
    SELECT strategy, query_id, count(*) AS n, max(score) AS top_score, round(sum(CAST(round(score * 1000000) AS BIGINT)) / count(*) / 1000000, 6) AS mean_score FROM h GROUP BY ALL
    """,
)
def strategies_by_query(spark, sf_dir):
    """A table of queries under three strategies, each node scored once."""
    n = nodes(spark, sf_dir)
    parts = {"first": n.where("label = 1"), "second": n.where("label = 2"), "rest": n.where("label IS NULL OR label NOT IN (1, 2)")}
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return A.strategy_query_stats(R.search_by_strategies(parts, STRATEGIES, asked))


def hashed_sql(name: str, source: str, text: str = "text") -> str:
    """Vectors of hashed words for each row of ``source`` (id, text): id, v."""
    return rf"""
    {name}_w AS (SELECT id, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]+')) AS w FROM {source}),
    {name}_h AS (SELECT id, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h FROM {name}_w),
    {name}_s AS (SELECT id, (h % 64)::INT AS i, sum(CASE WHEN h >= 9223372036854775808 THEN 1 ELSE -1 END)::DOUBLE AS x FROM {name}_h GROUP BY ALL),
    {name}_m AS (SELECT id, map_from_entries(list((i, x))) AS m, sqrt(sum(x * x)) AS norm FROM {name}_s GROUP BY id),
    {name} AS (SELECT s.id, list_transform(range(0, 64), lambda i: coalesce((CASE WHEN norm > 0 THEN m[i::INT] / norm ELSE 0 END)::FLOAT, 0::FLOAT)) AS v FROM {source} s LEFT JOIN {name}_m USING (id))"""


@query("u1_hash_embedding", f"""WITH d AS (SELECT doc_id AS id, text FROM documents), {hashed_sql("e", "d")}
    SELECT id AS doc_id, list_transform(v, lambda x: round(x::DOUBLE, 5)) AS embedding FROM e""")
def hash_embedding(spark, sf_dir):
    e = table(spark, sf_dir, "documents").select("doc_id", embedder()(F.col("text")).alias("embedding"))
    return e.select("doc_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


@query(
    "u1_text_search",
    f"""WITH d AS (SELECT doc_id AS id, text FROM documents), b AS (SELECT item_id AS id, text FROM benchmark), {hashed_sql("e", "d")}, {hashed_sql("q", "b")},
    s AS (SELECT q.id AS query_id, e.id AS node_id, round(list_cosine_similarity(e.v::DOUBLE[], q.v::DOUBLE[]), 6) AS score FROM e, q WHERE list_sum(list_transform(e.v, lambda x: x * x)) > 0)
    SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INT AS rank FROM s QUALIFY rank <= 5""",
)
def text_search(spark, sf_dir):
    """Documents nearest to each benchmark passage by hashed words."""
    embed = embedder()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), embed(F.col("text")).alias("embedding"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), embed(F.col("text")).alias("vector"))
    return R.search_many(docs, asked)


NODE_ROWS = """n AS (
      SELECT 'c' || conv_id || '_' || turn AS node_id, conv_id AS doc_id, text, NULL::VARCHAR AS window_text, 'chunk' AS type FROM conversations
      UNION ALL SELECT 'w' || conv_id || '_' || turn, conv_id, text, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), ' '), 'sentence' FROM conversations
      UNION ALL SELECT 's' || conv_id, conv_id, arg_max(text, struct_pack(n := length(text), t := text)), NULL, 'summary' FROM conversations GROUP BY conv_id),
    i AS (SELECT node_id AS id, text FROM n)"""


def node_rows(spark, sf_dir) -> DataFrame:
    """Chunks, sentence windows and summaries of the conversations, each kind as embedding rows."""
    c = table(spark, sf_dir, "conversations")
    name = lambda letter, *parts: F.concat(F.lit(letter), F.concat_ws("_", *[F.col(p).cast("string") for p in parts])).alias("node_id")
    chunks = c.select(name("c", "conv_id", "turn"), F.col("conv_id").alias("doc_id"), "text")
    windows = row_windows(c, "conv_id", "turn").select(name("w", "conv_id", "turn"), F.col("conv_id").alias("doc_id"), "text", "window_text")
    summaries = longest_chunk(c.withColumnRenamed("conv_id", "doc_id")).select(name("s", "doc_id"), "doc_id", "text")
    kinds = (chunks, "chunk"), (windows, "sentence"), (summaries, "summary")
    out = None
    for rows, kind in kinds:
        one = embedding_rows(rows, embedder(), kind)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


@query(
    "p18_embedding_rows",
    f"""WITH {NODE_ROWS}, {hashed_sql("e", "i")}
    SELECT node_id, doc_id, type, 1 AS batch_number, 64 AS embedding_dim, length(n.text)::INT AS text_length, length(window_text)::INT AS window_length,
           list_transform(v[1:3], lambda x: round(x::DOUBLE, 5)) AS first FROM n JOIN e ON e.id = n.node_id""",
)
def embedding_row_kinds(spark, sf_dir):
    """P18-P21, Z50."""
    return node_rows(spark, sf_dir).select(
        "node_id", "doc_id", "type", "batch_number", "embedding_dim", "text_length", "window_length", F.transform(F.slice("embedding", 1, 3), lambda x: F.round(x.cast("double"), 5)).alias("first")
    )


def searched(kind: str, k: int) -> str:
    return f"""(SELECT node_id, doc_id, text, window_text, score, row_number() OVER (ORDER BY score DESC, node_id)::INT AS rank FROM (
        SELECT n.*, round(list_cosine_similarity(v::DOUBLE[], (SELECT v::DOUBLE[] FROM q)), 6) AS score FROM n JOIN e ON e.id = n.node_id WHERE type = '{kind}' AND list_sum(list_transform(v, lambda x: x * x)) > 0) QUALIFY rank <= {k})"""


WINDOW_SEARCH = f"""WITH {NODE_ROWS}, {hashed_sql("e", "i")}, b AS (SELECT item_id AS id, text FROM benchmark ORDER BY item_id LIMIT 1), {hashed_sql("q", "b")}"""


def asked_first(spark, sf_dir) -> DataFrame:
    """One stated query: the first benchmark passage."""
    return table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select(F.col("item_id").alias("query_id"), embedder()(F.col("text")).alias("vector"))


def nearest(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    found = R.search_many(rows.select("node_id", "embedding"), asked, k)
    return rows.join(found, "node_id").select("node_id", "doc_id", "text", "window_text", "score", "rank")


@query("z24_window_search", f"{WINDOW_SEARCH} SELECT node_id, md5(window_text) AS text_md5, score, rank FROM {searched('sentence', 10)}")
def window_search(spark, sf_dir):
    """Sentences are searched, and their windows take the place of their texts."""
    rows = node_rows(spark, sf_dir).where("type = 'sentence'")
    hits_ = R.in_windows(nearest(rows, asked_first(spark, sf_dir), 10))
    return hits_.select("node_id", F.md5("text").alias("text_md5"), "score", "rank")


@query(
    "z25_decoupled_search",
    f"""{WINDOW_SEARCH}, h AS (SELECT * FROM {searched('summary', 5)})
    SELECT h.doc_id, n.node_id, h.score, row_number() OVER (PARTITION BY h.doc_id ORDER BY n.node_id)::INT AS place FROM h JOIN n ON n.doc_id = h.doc_id AND n.type = 'chunk' QUALIFY place <= 3""",
)
def decoupled_search(spark, sf_dir):
    """What is searched (a summary) is not what is returned (the first chunks of its document)."""
    rows = node_rows(spark, sf_dir)
    found = nearest(rows.where("type = 'summary'"), asked_first(spark, sf_dir), 5).select("doc_id", "score")
    chunks = rows.where("type = 'chunk'").select("doc_id", "node_id").join(found, "doc_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id"))
    return chunks.withColumn("place", place).where("place <= 3")


@query(
    "z26_chunk_strategies",
    f"""{WINDOW_SEARCH}, h AS ({" UNION ALL ".join(f"SELECT '{t}' AS strategy, * FROM {searched(t, 10)}" for t in ("chunk", "sentence", "summary"))})
    SELECT strategy, count(*) AS n, count(DISTINCT doc_id) AS documents, max(score) AS best, sum(CAST(round(score * 1000000) AS BIGINT))::BIGINT AS score_millionths, sum(length(coalesce(window_text, text)))::BIGINT AS characters FROM h GROUP BY strategy""",
)
def chunk_strategies(spark, sf_dir):
    """What the same question finds by chunks, by sentence windows and by summaries."""
    rows, asked = node_rows(spark, sf_dir), asked_first(spark, sf_dir)
    found = {t: R.in_windows(nearest(rows.where(F.col("type") == t), asked, 10)).select("node_id", "doc_id", "text", "score") for t in ("chunk", "sentence", "summary")}
    h = union_strategies(found)
    return h.groupBy("strategy").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"), F.max("score").alias("best"), F.sum(F.round(F.col("score") * 1_000_000).cast("long")).alias("score_millionths"), F.sum(F.length("text")).alias("characters")
    )


@query(
    "r10_semantic_and_keyword",
    f"""WITH d AS (SELECT doc_id AS id, text FROM documents), b AS (SELECT item_id AS id, text FROM benchmark ORDER BY item_id LIMIT 1), {hashed_sql("e", "d")}, {hashed_sql("q", "b")},
    {WEIGHTS_SQL.replace("    d AS (", "    wd AS (").replace("FROM d)", "FROM wd)")},
    asked AS (SELECT id AS query_id, unnest({TOKENS}) AS term FROM b),
    near AS (SELECT e.id AS node_id, round(list_cosine_similarity(e.v::DOUBLE[], q.v::DOUBLE[]), 6) AS score FROM e, q WHERE list_sum(list_transform(e.v, lambda x: x * x)) > 0),
    semantic AS (SELECT node_id, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM near QUALIFY rank <= 20),
    keyword AS (SELECT node_id, score, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM (SELECT node_id, round(sum(tf * idf), 8) AS score FROM asked JOIN c USING (term) JOIN f USING (term) GROUP BY node_id) QUALIFY rank <= 20),
    u AS (SELECT node_id, rank FROM semantic UNION ALL SELECT node_id, rank FROM keyword)
    SELECT node_id, score, row_number() OVER (ORDER BY score DESC, node_id)::INT AS rank FROM (SELECT node_id, round(sum(1 / (60 + rank)), 9) AS score FROM u GROUP BY node_id) QUALIFY rank <= 10""",
)
def semantic_and_keyword(spark, sf_dir):
    """Nearest by vector and best by keyword, fused by their ranks."""
    embed = embedder()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")
    asked = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    semantic = R.search_many(docs.select("node_id", embed(F.col("text")).alias("embedding")), asked.select("query_id", embed(F.col("query")).alias("vector")), 20)
    found = R.keyword_search(docs, asked, 20)
    both = semantic.select(F.lit("semantic").alias("list"), "node_id", "rank").union(found.select(F.lit("keyword").alias("list"), "node_id", "rank"))
    return R.fuse(both, "rrf", 10)


@query(
    "r22_multi_query",
    """
    WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS node_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
               FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
    h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 5)
    SELECT node_id, max(score) AS score, row_number() OVER (ORDER BY max(score) DESC, node_id)::INT AS rank FROM h GROUP BY node_id QUALIFY rank <= 10
    """,
)
def multi_query(spark, sf_dir):
    """The hits of several sub-queries, once each, cut to the best of all."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.union_of_queries(R.search_many(nodes(spark, sf_dir), asked), 10)


@query("k5_round_robin", "SELECT event_id, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 3)::INT AS turn FROM events")
def round_robin(spark, sf_dir):
    return take_turns(table(spark, sf_dir, "events"), ["event_id"], ["vector", "hybrid", "summary"], ["event_type"]).select("event_id", "turn")


