"""Queries on stored indexes: each writes its index to the shared folder and searches it."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.operators import candidates, inference, keyword_index, range_index, vector_index
from corpuslode.operators.filters import Filter
from corpuslode.plans import catalog_search  # noqa: F401  its SQL is used here
from corpuslode.plans.catalog_stats import LOG, log
from corpuslode.registry import ORACLES, query, table
from corpuslode.sources import log_store, markdown_sink, tables
from corpuslode.sources.files import BATCH_FILES, workspace


@query("r6_stored_index", ORACLES["r6_keyword_topk"])
def stored_keywords(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    path = workspace(spark, "keywords")
    keyword_index.write(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text"), path)
    return keyword_index.search(spark, path, asked)


@query("z5_stored_vectors", ORACLES["r26_batch_topk"])
def stored_vectors(spark, sf_dir):
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    path = workspace(spark, "vectors")
    vector_index.write(nodes, path)
    return vector_index.search(spark, path, asked)


def steered(spark, sf_dir, filters, how="and"):
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", "label")
    asked = catalog_search.vector(spark, sf_dir, 0)
    return candidates.steered_search(nodes, candidates.bitmap_index(nodes, ["label"]), filters, asked, 10, how).select("node_id", "label", "score", "rank")


def steered_sql(where):
    return f"SELECT node_id, label, score, row_number() OVER (ORDER BY score DESC, node_id)::INT AS rank FROM {catalog_search.sim(0)} WHERE {where} QUALIFY rank <= 10"


@query("f7_few_candidates", steered_sql("label IN (1, 2) AND label > 1"))
def few_candidates(spark, sf_dir):
    return steered(spark, sf_dir, [Filter("label", [1, 2], "IN"), Filter("label", 1, "GT")])


@query("f7_most_are_candidates", steered_sql("label <> 3 OR label >= 1"))
def most_are_candidates(spark, sf_dir):
    return steered(spark, sf_dir, [Filter("label", [0, 1, 2, 4, 5, 6, 7, 8, 9], "IN"), Filter("label", 1, "GTE")], "or")


@query("d4_value_counts", "SELECT lang, source, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL")
def value_counts(spark, sf_dir):
    """The sizes of all intersections of a language and a source, from the bitmaps alone."""
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "lang", "source")
    index = candidates.bitmap_index(nodes, ["lang", "source"])
    side = lambda f: index.where(F.col("field") == f).select(F.col("value").alias(f), "bucket", "bits")
    pairs = side("lang").join(side("source").withColumnRenamed("bits", "more"), "bucket")
    both = pairs.select("lang", "source", "bucket", F.explode(F.array("bits", "more")).alias("b")).groupBy("lang", "source", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("b")).alias("n"))
    return both.groupBy("lang", "source").agg(F.sum("n").alias("n")).where("n > 0")


def phrases(spark, sf_dir):
    """Short words of the benchmark's texts as phrases: each stands for a language or a source, by the rank of its item."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,5}"), F.lit(0)))).alias("phrase")
    words = table(spark, sf_dir, "benchmark").select("item_id", word).groupBy("phrase").agg(F.min("item_id").alias("place"))
    lang = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("place") % 4 + 1).cast("int"))
    source = F.concat(F.lit("src"), (F.col("place") % 20).cast("string"))
    even = F.length("phrase") == 4
    return words.select("phrase", F.when(even, "lang").otherwise("source").alias("field"), F.when(even, lang).otherwise(source).alias("value"), "place")


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


PHRASES_SQL = """
    w AS (SELECT word AS phrase, min(item_id) AS place FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,5}')) AS word FROM benchmark) GROUP BY ALL),
    p AS (SELECT phrase, place, CASE WHEN length(phrase) = 4 THEN 'lang' ELSE 'source' END AS field,
                 CASE WHEN length(phrase) = 4 THEN ['en', 'de', 'fr', 'es'][place % 4 + 1] ELSE 'src' || (place % 20) END AS value FROM w),
    q AS (SELECT conv_id * 1000 + turn AS query_id, lower(text) AS low FROM conversations WHERE role = 'user'),
    i AS (SELECT query_id, field, value FROM q JOIN p ON contains(low, phrase) QUALIFY row_number() OVER (PARTITION BY query_id, field ORDER BY place DESC, phrase DESC, value DESC) = 1)"""


@query("f18_inferred", f"WITH {PHRASES_SQL} SELECT * FROM i")
def inferred_filters(spark, sf_dir):
    return inference.infer(turns(spark, sf_dir), phrases(spark, sf_dir))


GIVEN_SQL = "g AS (SELECT query_id, 'lang' AS field, 'en' AS value FROM q WHERE query_id % 3 = 0), f AS (SELECT * FROM g UNION ALL SELECT * FROM i ANTI JOIN g USING (query_id, field))"


@query(
    "z21_auto_filtered",
    f"""
    WITH {PHRASES_SQL}, {GIVEN_SQL},
    s AS (SELECT query_id, max(value) FILTER (field = 'lang') AS lang, max(value) FILTER (field = 'source') AS source FROM q LEFT JOIN f USING (query_id) GROUP BY query_id)
    SELECT query_id, doc_id AS node_id, n_chars, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id)::INT AS rank
    FROM s JOIN documents d ON (s.lang IS NULL OR s.lang = d.lang) AND (s.source IS NULL OR s.source = d.source) QUALIFY rank <= 3
    """,
)
def auto_filtered(spark, sf_dir):
    asked = turns(spark, sf_dir)
    given = asked.where("query_id % 3 = 0").select("query_id", F.lit("lang").alias("field"), F.lit("en").alias("value"))
    filters = inference.overridden(inference.infer(asked, phrases(spark, sf_dir)), given)
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "lang", "source", "n_chars")
    return inference.search_filtered(nodes, asked, filters, ["lang", "source"], "n_chars", 3)


@query(
    "f14_checked_answers",
    """
    WITH a AS (SELECT conv_id * 1000 + turn AS query_id, CASE WHEN turn % 2 = 0 THEN 'lang' ELSE 'source' END AS field,
                      CASE WHEN turn % 4 = 0 THEN ['en', 'xx'][conv_id % 2 + 1] ELSE 'src' || (conv_id % 30) END AS value FROM conversations)
    SELECT query_id, field, value FROM a WHERE (field, value) IN (SELECT ('lang', lang) FROM documents UNION SELECT ('source', source) FROM documents)
    """,
)
def checked_answers(spark, sf_dir):
    even = F.col("turn") % 2 == 0
    value = F.when(F.col("turn") % 4 == 0, F.element_at(F.array(F.lit("en"), F.lit("xx")), (F.col("conv_id") % 2 + 1).cast("int"))).otherwise(F.concat(F.lit("src"), (F.col("conv_id") % 30).cast("string")))
    field = F.when(even, "lang").otherwise("source")
    answers = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.to_json(F.create_map(field, value, F.lit("nothing"), F.col("role"))).alias("answer"))
    known = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("lang", "source")])).alias("v")
    return inference.checked(answers, table(spark, sf_dir, "documents").select(known).select("v.*").where("value IS NOT NULL").distinct())


@query(
    "s6_markdown_batches",
    """
    SELECT doc_id::VARCHAR AS file_doc_id, coalesce(lang, 'unknown') AS folder, md5(text) AS text_md5,
           ((row_number() OVER (ORDER BY coalesce(lang, 'unknown') || '/' || doc_id || '.md') - 1) // 20 + 1)::INT AS batch_number
    FROM documents WHERE text IS NOT NULL AND text <> ''
    """,
)
def markdown_batches(spark, sf_dir):
    """Documents as files of their own names, read back and numbered in batches of 20."""
    path = workspace(spark, "markdown")
    markdown_sink.write(table(spark, sf_dir, "documents").where("text <> ''"), path, "lang")
    files = markdown_sink.read(spark, path, size=BATCH_FILES)
    return files.select("file_doc_id", "folder", F.md5("text").alias("text_md5"), "batch_number")


def columns_sql(names):
    """A row for each column of the tables, its values counted by what they can be read as."""
    one = """SELECT '{c}' AS "column", count(v) AS n, count(v) FILTER (regexp_matches(v, '^\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{4}}$|^\\d{{4}}[/-]\\d{{1,2}}[/-]\\d{{1,2}}$')) AS dates,
        count(TRY_CAST(v AS BIGINT)) AS whole, count(TRY_CAST(v AS DOUBLE)) AS numbers, any_value(kind) AS kind
        FROM (SELECT nullif(trim({c}::VARCHAR), '') AS v, typeof({c}) AS kind FROM {t})"""
    return " UNION ALL ".join(one.format(t=t, c=c) for t, c in names)


KEYS_SQL = ", ".join(f"('{kind}', [{', '.join(map(repr, keys))}])" for kind, keys in tables.METADATA_KEYS.items())
PATTERNS_SQL = ", ".join(f"({i}, '{kind}', '{p}')" for i, (kind, p) in enumerate((k, p) for k, ps in tables.FIELD_PATTERNS.items() for p in ps))
ANALYZED = [("part", c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")] + [("documents", c) for c in ("lang", "source", "n_chars")]


@query(
    "z47_columns",
    f"""
    WITH c AS ({columns_sql(ANALYZED)}), k(kind, keys) AS (VALUES {KEYS_SQL}), p(i, kind, pattern) AS (VALUES {PATTERNS_SQL}),
    m AS (SELECT "column", p.kind, length(regexp_extract(lower("column"), pattern)) / length("column") AS share, i FROM c CROSS JOIN p),
    b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY share DESC, i) = 1),
    s AS (SELECT "column", CASE WHEN share > 0 THEN kind ELSE 'other' END AS field_type, CASE WHEN share > 0 THEN round(share, 6) ELSE 0.1 END AS confidence FROM b)
    SELECT s.*, coalesce(list_filter(keys, lambda x: contains(lower("column"), x) OR contains(x, lower("column")))[1],
                         list_filter(keys, lambda x: len(list_filter(string_split(x, '_'), lambda y: NOT contains(lower("column"), y))) = 0)[1],
                         regexp_replace(lower("column"), '[^a-z0-9]+', '_', 'g')) AS key,
           CASE WHEN c.kind LIKE '%INT%' THEN 'integer' WHEN c.kind IN ('DOUBLE', 'FLOAT') OR c.kind LIKE 'DECIMAL%' THEN 'numeric' WHEN n = 0 THEN 'string'
                WHEN dates >= 0.7 * n THEN 'date' WHEN whole = n THEN 'integer' WHEN numbers = n THEN 'numeric' ELSE 'string' END AS data_type, n
    FROM s JOIN c USING ("column") LEFT JOIN k ON k.kind = s.field_type
    """,
)
def columns(spark, sf_dir):
    """Both tables' columns, each table read once."""
    of = lambda name: tables.analyzed(table(spark, sf_dir, name).select(*[c for t, c in ANALYZED if t == name]))
    return of("part").unionByName(of("documents"))


def ordered_fields(spark, sf_dir):
    path = workspace(spark, "ranges")
    nodes = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "node_id")
    range_index.write(nodes, path, ["o_totalprice", "o_custkey"], zone_rows=2_000)
    return path


@query("f3_range_index", "SELECT o_orderkey AS node_id FROM orders WHERE o_totalprice > 150000.5 AND o_custkey <= 700.5")
def range_search(spark, sf_dir):
    """two comparisons, each from the zones of its own field."""
    return range_index.where(spark, ordered_fields(spark, sf_dir), [Filter("o_totalprice", 150000.5, "GT"), Filter("o_custkey", 700.5, "LTE")])


@query("f4_range_index_or", "SELECT o_orderkey AS node_id FROM orders WHERE o_totalprice < 20000 OR o_custkey IN (4, 7, 11)")
def range_search_or(spark, sf_dir):
    return range_index.where(spark, ordered_fields(spark, sf_dir), [Filter("o_totalprice", 20000, "LT"), Filter("o_custkey", [4, 7, 11], "IN")], "or")


# Comparisons whose nodes are counted.
COMPARED = [("o_totalprice", ">", 100000), ("o_totalprice", ">=", 250000.5), ("o_totalprice", "<", 50000), ("o_custkey", "<=", 900), ("o_custkey", ">", -1), ("o_custkey", "<", 0)]


@query("a16_range_counts", " UNION ALL ".join(f"SELECT '{f} {o} {v}' AS asked, count(*) AS n FROM orders WHERE {f} {o} {v}" for f, o, v in COMPARED))
def range_counts(spark, sf_dir):
    """Sizes of candidate sets by the zones' sizes; of the values only those of the zone at a bound are read."""
    path = ordered_fields(spark, sf_dir)
    names = {">": "GT", ">=": "GTE", "<": "LT", "<=": "LTE"}
    counted = [range_index.count(spark, path, Filter(f, v, names[o])).select(F.lit(f"{f} {o} {v}").alias("asked"), "n") for f, o, v in COMPARED]
    return reduce(DataFrame.union, counted)


@query(
    "s30_daily_store",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS day, strategy, count(*) AS n, count(error) AS errors, sum(prompt_tokens)::BIGINT AS prompt_tokens FROM {LOG}
        WHERE ts::DATE >= (SELECT max(ts)::DATE FROM events) - 7 GROUP BY ALL""",
)
def daily_store(spark, sf_dir):
    """The entries arrive by a stream in several batches, are compacted by day, and days more than seven before the last are dropped."""
    path = workspace(spark, "daily")
    e = log(spark, sf_dir)
    arriving = e.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("query", F.lit("")).withColumn("timestamp", F.lit("")).withColumn("confidence", F.lit(0.5))
    arriving.repartition(6).write.parquet(f"{path}/arriving")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/arriving").schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/arriving")
    log_store.append_stream(stream, f"{path}/days", f"{path}/checkpoint").awaitTermination()
    log_store.compact(spark, f"{path}/days")
    log_store.sweep(spark, f"{path}/days")
    last = log_store.read(spark, f"{path}/days").agg(F.max("day")).first()[0]
    if last is not None:
        log_store.drop_days(spark, f"{path}/days", last - datetime.timedelta(days=7))
    kept = log_store.read(spark, f"{path}/days").groupBy("day", "strategy")
    return kept.agg(F.count("*").alias("n"), F.count("error").alias("errors"), F.sum("prompt_tokens").alias("prompt_tokens")).withColumn("day", F.col("day").cast("string"))
