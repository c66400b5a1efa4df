"""Queries on statistics, validation, logs and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslode.functions.values import token_cost
from corpuslode.operators import filters as L
from corpuslode.operators import stats as A
from corpuslode.operators.filters import by_values
from corpuslode.registry import query, table
from corpuslode.sources import files, markdown_sink
from corpuslode.sources import tables as S
from corpuslode.streaming.logs import to_parquet, windowed

CUSTOMERS = "customer JOIN nation ON c_nationkey = n_nationkey"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"])


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log entries: the type is the strategy, the value the latency, ``error`` events have failed."""
    return entries(table(spark, sf_dir, "events"))


def entries(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "ts", F.col("event_type").alias("strategy"), F.concat(F.lit("index"), (F.col("user_id") % 3).cast("string")).alias("index"), F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("prompt_tokens"), (F.col("event_id") % 50).alias("completion_tokens"), F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
    )


LOG = """(SELECT event_id, ts, event_type AS strategy, 'index' || user_id % 3 AS index, value AS latency_ms, json_extract_string(props, '$.k')::BIGINT AS prompt_tokens, event_id % 50 AS completion_tokens,
          CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events)"""


@query(
    "a1_field_coverage",
    f"""
    WITH d AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN '' ELSE n_name END AS province, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS deed_type FROM {CUSTOMERS}),
    f AS (SELECT 'province' AS field, count(nullif(province, '')) AS given, count(*) AS n FROM d UNION ALL SELECT 'deed_type', count(nullif(deed_type, '')), count(*) FROM d)
    SELECT field, given, round(100.0 * given / n, 2)::DOUBLE AS percent FROM f
    """,
)
def field_coverage(spark, sf_dir):
    k = F.col("c_custkey")
    d = customers(spark, sf_dir).select(F.when(k % 3 == 0, "").otherwise(F.col("n_name")).alias("province"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("deed_type"))
    return A.coverage(d, ["province", "deed_type"])


@query("r24_top_values", f"SELECT n_name AS value, count(*) AS n FROM {CUSTOMERS} GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_values(spark, sf_dir):
    return A.top_values(customers(spark, sf_dir), "n_name")


@query("a1_spread", "SELECT min(p_retailprice) AS least, max(p_retailprice) AS largest, round(sum(CAST(round(p_retailprice * 100) AS BIGINT)) / count(*) / 100, 6)::DOUBLE AS mean, count(p_retailprice) AS n FROM part")
def spread(spark, sf_dir):
    return A.spread(table(spark, sf_dir, "part"), "p_retailprice")


@query(
    "a3_chunk_statistics",
    """SELECT lang, count(*) AS chunks, round(sum(length(text)) / count(*), 6) AS mean_length, count(*) FILTER (length(text) < 200) AS short, count(*) FILTER (length(text) BETWEEN 200 AND 800) AS medium,
       count(*) FILTER (length(text) > 800) AS long FROM documents GROUP BY lang""",
)
def chunk_statistics(spark, sf_dir):
    return A.chunk_stats(table(spark, sf_dir, "documents"), "lang")


@query(
    "a4_embedding_validation",
    """SELECT label, count(*) AS n, array_to_string(list_sort(list(DISTINCT len(embedding))), ',') AS dimensions, count(*) FILTER (embedding IS NULL OR len(embedding) = 0) AS no_vector,
       count(*) FILTER (t IS NULL OR t = '') AS no_text, round(avg(length(t)), 6) AS mean_text_length FROM (SELECT *, CASE WHEN vec_id % 7 = 0 THEN '' ELSE 'text ' || vec_id END AS t FROM embeddings) GROUP BY label""",
)
def embedding_validation(spark, sf_dir):
    t = F.when(F.col("vec_id") % 7 == 0, "").otherwise(F.concat(F.lit("text "), F.col("vec_id").cast("string")))
    e = table(spark, sf_dir, "embeddings").withColumn("t", t)
    return A.embedding_validation(e, text=F.col("t"), kind="label").withColumn("dimensions", F.array_join("dimensions", ","))


@query(
    "a5_quality_score",
    """
    WITH e AS (SELECT embedding, vec_id, quality FROM embeddings LEFT JOIN labels ON vec_id = doc_id),
    a AS (SELECT count(*) AS n, count(DISTINCT len(embedding)) AS dims, count(*) FILTER (vec_id % 7 <> 0) AS texts, count(*) FILTER (len(embedding) > 0) AS vectors, count(*) FILTER (quality IS NULL) AS missing_0 FROM e)
    SELECT *, round(0.2 * CASE WHEN dims > 1 THEN 0.5 ELSE 1.0 END + 0.3 * texts / n + 0.3 * vectors / n + 0.2 * greatest(0.0, 1 - missing_0 / n * 0.5), 6)::DOUBLE AS quality_score FROM a
    """,
)
def quality_score(spark, sf_dir):
    e, l = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "labels")  # noqa: E741
    d = e.join(l, e["vec_id"] == l["doc_id"], "left")
    return A.quality_score(d, "embedding", F.when(F.col("vec_id") % 7 != 0, "x"), [F.col("quality")])


@query("a5_sparse_fields", "WITH k AS (SELECT unnest(json_keys(props)) AS field FROM events WHERE event_id % 2 = 0) SELECT field, count(*) AS n FROM k GROUP BY field HAVING count(*) < 0.8 * (SELECT count(*) FROM events)")
def sparse_fields(spark, sf_dir):
    m = F.when(F.col("event_id") % 2 == 0, F.from_json("props", "map<string,string>"))
    return A.sparse_fields(table(spark, sf_dir, "events").select(m.alias("metadata")))


@query("a6_distribution", "SELECT coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END, ''), 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def distribution(spark, sf_dir):
    return A.top_values(table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("lang")).alias("lang")), "lang", missing="unknown")


@query("a6_area_buckets", "SELECT CASE WHEN p_size <= 1 THEN '0-1' WHEN p_size <= 5 THEN '1-5' WHEN p_size <= 10 THEN '5-10' WHEN p_size <= 50 THEN '10-50' ELSE '50+' END AS bucket, count(*) AS n FROM part GROUP BY 1")
def area_buckets(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(A.rai_bucket(F.col("p_size")).alias("bucket")).agg(F.count("*").alias("n"))


@query("a10_totals", "SELECT doc_id % 4 AS batch, lang AS type, count(*) AS n FROM documents GROUP BY ROLLUP (1, 2)")
def totals(spark, sf_dir):
    return A.totals(table(spark, sf_dir, "documents"), F.col("doc_id") % 4, F.col("lang"))


@query("a11_log_summary", f"SELECT index, count(*) AS total, count(*) FILTER (error IS NULL) AS success, count(*) FILTER (error IS NOT NULL) AS errors, round(100.0 * count(*) FILTER (error IS NULL) / count(*), 1)::DOUBLE AS success_rate FROM {LOG} GROUP BY index")
def log_summary(spark, sf_dir):
    return A.log_summary(log(spark, sf_dir), ["index"])


@query(
    "a11_log_latency",
    f"""
    SELECT strategy, count(*) AS n, round(sum(CAST(round(latency_ms * 100) AS BIGINT)) / count(*) / 100, 4)::DOUBLE AS mean_ms, round(median(latency_ms), 4) AS median_ms,
           list_sort(list(latency_ms))[CAST(floor(count(*) * 0.95) AS INT) + 1] AS p95_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms
    FROM {LOG} WHERE latency_ms > 0 GROUP BY strategy
    """,
)
def log_latency(spark, sf_dir):
    return A.log_latency(log(spark, sf_dir), ["strategy"])


@query(
    "a11_log_costs",
    f"""
    SELECT strategy, count(*) AS n, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
           round(sum(prompt_tokens) / 1000 * 0.00015 + sum(completion_tokens) / 1000 * 0.0006, 9) AS cost, round((sum(prompt_tokens) / 1000 * 0.00015 + sum(completion_tokens) / 1000 * 0.0006) / count(*), 9) AS mean_cost
    FROM {LOG} WHERE prompt_tokens > 0 OR completion_tokens > 0 GROUP BY strategy
    """,
)
def log_costs(spark, sf_dir):
    return A.log_costs(log(spark, sf_dir), ["strategy"])


@query("a11_top_strategies", f"SELECT strategy AS value, count(*) AS n FROM {LOG} GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def top_strategies(spark, sf_dir):
    return A.top_values(log(spark, sf_dir), "strategy", 5)


@query("a11_top_indexes", f"SELECT index, count(*) AS n FROM {LOG} GROUP BY 1 ORDER BY n DESC, index LIMIT 5")
def top_indexes(spark, sf_dir):
    return A.most_frequent(log(spark, sf_dir), "index", 5)


@query("a11_top_errors", f"SELECT error, count(*) AS n FROM {LOG} WHERE error IS NOT NULL GROUP BY 1 ORDER BY n DESC, error LIMIT 3")
def top_errors(spark, sf_dir):
    return A.most_frequent(log(spark, sf_dir), "error", 3)


@query(
    "a11_median_cost",
    f"""SELECT strategy, round(median(c), 10) AS median_cost FROM (
        SELECT strategy, round(coalesce(prompt_tokens, 0) / 1000 * 0.00015 + coalesce(completion_tokens, 0) / 1000 * 0.0006, 9)::DOUBLE AS c FROM {LOG} WHERE prompt_tokens > 0 OR completion_tokens > 0) GROUP BY strategy""",
)
def median_cost(spark, sf_dir):
    return A.median_cost(log(spark, sf_dir), ["strategy"])


@query("a12_token_cost", f"SELECT event_id, round(prompt_tokens / 1000 * 0.00015 + completion_tokens / 1000 * 0.0006, 9) AS cost FROM {LOG}")
def token_costs(spark, sf_dir):
    return log(spark, sf_dir).select("event_id", F.round(token_cost(F.col("prompt_tokens"), F.col("completion_tokens")), 9).alias("cost"))


@query("a13_value_inventory", "SELECT DISTINCT 'lang' AS field, lang AS value FROM documents UNION SELECT DISTINCT 'source', source FROM documents")
def value_inventory(spark, sf_dir):
    return A.value_inventory(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("a15_running_mean", "SELECT event_id, round(sum(CAST(round(value * 100) AS BIGINT)) OVER w / count(value) OVER w / 100, 6)::DOUBLE AS running_mean FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_mean(spark, sf_dir):
    return A.running_mean(table(spark, sf_dir, "events"), "value", ["event_id"], ["event_type"]).select("event_id", "running_mean")


@query("a16_index_size", "SELECT count(DISTINCT lower(trim(lang))) AS keyword_lang, count(DISTINCT lower(trim(source))) AS keyword_source, count(n_chars) AS numeric_n_chars FROM documents")
def index_size(spark, sf_dir):
    return A.index_size(table(spark, sf_dir, "documents"), ["lang", "source"], ["n_chars"])


@query("z51_inverted_index", "SELECT 'lang' AS field, lower(trim(lang)) AS value, doc_id AS node_id FROM documents UNION ALL SELECT 'source', lower(trim(source)), doc_id FROM documents")
def inverted_index(spark, sf_dir):
    return A.inverted_index(table(spark, sf_dir, "documents"), "doc_id", ["lang", "source"])


@query("a17_filter_ratio", "SELECT count(*) AS original, count(*) FILTER (lang = 'en') AS filtered, round(1 / count(*) * count(*) FILTER (lang = 'en'), 6)::DOUBLE AS ratio FROM documents")
def filter_ratio(spark, sf_dir):
    return A.filter_ratio(table(spark, sf_dir, "documents"), F.col("lang") == "en")


@query(
    "a20_accuracy",
    "SELECT count(*) AS total, count(*) FILTER (p = quality) AS correct, round(count(*) FILTER (p = quality) / count(*), 6) AS accuracy FROM (SELECT quality, CASE WHEN n_chars > 100 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id))",
)
def accuracy(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return A.accuracy(d, F.when(F.col("n_chars") > 100, 1).otherwise(0), F.col("quality"))


@query("a21_strategy_stats", "SELECT event_type AS strategy, count(*) AS queries, round(sum(CAST(round(value * 100) AS BIGINT)) / count(*) / 100, 6)::DOUBLE AS mean_ms, round(sum(user_id % 7) / count(*), 6) AS mean_results FROM events GROUP BY 1")
def strategy_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("strategy"), F.col("value").alias("latency_ms"), (F.col("user_id") % 7).alias("n_results"))
    return A.strategy_stats(e)


RESULTS = "SELECT event_type AS strategy, round(sum(CAST(round(value * 100) AS BIGINT)) / count(*) / 100, 6)::DOUBLE AS latency_ms, count(*) AS n_results, CASE WHEN event_type = 'error' THEN 'x' END AS error FROM events GROUP BY event_type"


@query("a22_best_strategy", f"WITH r AS ({RESULTS}) (SELECT 'fastest' AS how, strategy FROM r WHERE error IS NULL ORDER BY latency_ms, strategy LIMIT 1) UNION ALL (SELECT 'most_results', strategy FROM r WHERE error IS NULL ORDER BY n_results DESC, strategy LIMIT 1) UNION ALL (SELECT 'best', strategy FROM r WHERE error IS NULL ORDER BY -latency_ms DESC, strategy LIMIT 1)")
def best_strategy(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("strategy")).agg(
        F.round(F.sum(A.hundredths(F.col("value"))) / F.count("*") / 100, 6).alias("latency_ms"), F.count("*").alias("n_results"))
    r = e.withColumn("error", F.when(F.col("strategy") == "error", "x")).withColumn("mean_score", -F.col("latency_ms"))
    out = None
    for how in ("fastest", "most_results", "best"):
        one = A.best_strategy(r, how).select(F.lit(how).alias("how"), "strategy")
        out = one if out is None else out.unionByName(one)
    return out


@query("a24_cache_rate", "SELECT count(*) FILTER (user_id % 3 = 0) AS hits, count(*) FILTER (user_id % 3 <> 0) AS misses, round(count(*) FILTER (user_id % 3 = 0) / count(*), 6) AS hit_rate FROM events")
def cache_rate(spark, sf_dir):
    return A.cache_rate(table(spark, sf_dir, "events"), F.col("user_id") % 3 == 0)


SNAPSHOTS = """(SELECT vec_id, label, vec_id % 4 AS batch_number, CASE vec_id % 3 WHEN 0 THEN 'chunk' WHEN 1 THEN 'summary' ELSE 'indexnode' END AS type, stamp
    FROM embeddings, (SELECT unnest(['20240101', '20240202']) AS stamp) WHERE stamp = '20240202' OR vec_id % 2 = 0)"""


def snapshot_store(spark: SparkSession, sf_dir: str) -> str:
    """The embeddings written as two snapshots, the older one with half of them."""
    path = files.workspace(spark, "snapshots")
    i = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", "embedding", (i % 4).cast("int").alias("batch_number"), F.when(i % 3 == 0, "chunk").when(i % 3 == 1, "summary").otherwise("indexnode").alias("type")
    )
    files.write_snapshot(e.where("vec_id % 2 = 0"), path, "20240101")
    files.write_snapshot(e, path, "20240202")
    return path


@query("s10_snapshots", f"SELECT DISTINCT stamp AS batch_ts FROM {SNAPSHOTS}")
def snapshot_stamps(spark, sf_dir):
    return files.snapshots(spark, snapshot_store(spark, sf_dir)).select(F.col("batch_ts").cast("string").alias("batch_ts"))


@query("s11_latest_snapshot", f"SELECT vec_id, type, batch_number::INT AS batch_number FROM {SNAPSHOTS} WHERE stamp = '20240202'")
def latest_snapshot(spark, sf_dir):
    """All batches and types of the latest snapshot, as they were written."""
    return files.read_snapshot(spark, snapshot_store(spark, sf_dir)).select("vec_id", "type", "batch_number")


@query("s14_snapshot_of_type", f"SELECT vec_id FROM {SNAPSHOTS} WHERE stamp = '20240101' AND type IN ('chunk', 'summary') AND batch_number = 2")
def snapshot_of_type(spark, sf_dir):
    """Types and a batch of a given snapshot; its folders prune the read."""
    return files.read_snapshot(spark, snapshot_store(spark, sf_dir), ["chunk", "summary"], 2, "20240101").select("vec_id")


@query(
    "z8_load_and_validate",
    f"SELECT type, count(*) AS n, count(DISTINCT label) AS labels, 64 AS dimensions FROM {SNAPSHOTS} WHERE stamp = '20240202' AND label IN (1, 2, 3) GROUP BY type",
)
def load_and_validate(spark, sf_dir):
    """The latest snapshot, filtered as an index of its own, with what a check of it tells."""
    e = by_values(files.read_snapshot(spark, snapshot_store(spark, sf_dir)), "label", [1, 2, 3])
    return e.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.max(F.size("embedding")).alias("dimensions"))


@query("s2_csv_round_trip", "SELECT p_partkey, p_name, p_brand, p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part")
def csv_round_trip(spark, sf_dir):
    """The table written as CSV files and read back, split among tasks, with a schema."""
    path = files.workspace(spark, "csv")
    S.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), path)
    back = S.read_csv(spark, path, "utf-8", "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double")
    return back.where("_corrupt_record IS NULL").select("p_partkey", "p_name", "p_brand", "p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))


@query("s3_csv_with_broken_lines", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def csv_with_broken_lines(spark, sf_dir):
    """Whole texts, quotes and line ends included, through CSV."""
    path = files.workspace(spark, "csv")
    S.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return S.read_csv(spark, path, "utf-8", "doc_id long, text string").select("doc_id", F.md5("text").alias("text_md5"))


@query("s19_markdown_files", "SELECT source AS folder, doc_id, md5(text) AS text_md5 FROM documents")
def markdown_files(spark, sf_dir):
    """A file for each document, in folders, read back whole."""
    path = files.workspace(spark, "markdown")
    markdown_sink.write(table(spark, sf_dir, "documents"), path, "source")
    # where several texts have one id, a hash stands behind it
    doc_id = F.regexp_extract("file_name", r"^(.+?)(-[0-9a-f]{12})?\.md$", 1).cast("long").alias("doc_id")
    return markdown_sink.read(spark, path).select("folder", doc_id, F.md5("text").alias("text_md5"))


@query(
    "s20_markdown_index",
    "SELECT source, count(*) AS n, list(doc_id ORDER BY doc_id)[1:10] AS first FROM documents GROUP BY source",
)
def markdown_index(spark, sf_dir):
    found = files.markdown_index(table(spark, sf_dir, "documents"), "source")
    return found.select("source", "n", F.transform("documents", lambda x: x["doc_id"]).alias("first"))


@query("s18_jsonl", "SELECT doc_id AS id, md5(text) AS text_md5, lang FROM documents")
def jsonl(spark, sf_dir):
    path = files.workspace(spark, "jsonl")
    d = table(spark, sf_dir, "documents")
    files.write_jsonl(d.withColumn("metadata", F.create_map(F.lit("lang"), F.col("lang"))), path, ["lang"])
    back = spark.read.schema("id long, text string, embedding_priority_fields map<string,string>").json(path)
    return back.select("id", F.md5("text").alias("text_md5"), F.col("embedding_priority_fields")["lang"].alias("lang"))


@query(
    "s26_log_store",
    f"SELECT strategy, count(*) AS n, count(error) AS errors FROM {LOG} WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY strategy",
)
def log_store(spark, sf_dir):
    """Entries appended twice over as compressed JSON lines, compacted, read back, and kept for seven days behind the last one."""
    path = files.workspace(spark, "log")
    e = log(spark, sf_dir)
    stored = e.select("ts", "strategy", "latency_ms", "error", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).withColumn("prompt_tokens", F.lit(0)).withColumn("completion_tokens", F.lit(0))
    stored = stored.drop("ts").withColumnRenamed("t", "ts").withColumn("confidence", F.lit(None).cast("double"))
    for half in (0, 1):
        files.append_log(stored.where(F.pmod(F.xxhash64("ts", "strategy"), F.lit(2)) == half), f"{path}/entries")
    files.compact_log(spark, f"{path}/entries", f"{path}/compact", 2)
    back = files.read_log(spark, f"{path}/compact")
    last = back.agg(F.max("ts")).first()[0]
    kept = files.kept_log(back, 7, F.timestamp_seconds(F.lit(last)))
    return kept.groupBy("strategy").agg(F.count("*").alias("n"), F.count("error").alias("errors"))


@query("f7_prefilter_plan", "SELECT count(*) AS total, count(*) FILTER (lang = 'de') AS candidates, count(*) FILTER (lang = 'de') BETWEEN 1 AND 0.8 * count(*) AS worth FROM documents")
def prefilter_plan(spark, sf_dir):
    return L.prefilter_plan(table(spark, sf_dir, "documents"), F.col("lang") == "de")


@query("f20_section_chunks", "SELECT doc_id FROM documents WHERE source = 'src1' OR lang IN ('de')")
def section_chunk_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kinds = d.select("doc_id", F.when(F.col("source") == "src1", "section_chunk").otherwise("chunk").alias("type"), F.when(F.col("lang") == "de", "section_part").otherwise("plain").alias("chunk_type"))
    return L.section_chunks(kinds).select("doc_id")


@query("s1_profile", "SELECT 'lang' AS column, count(*) FILTER (lang IS NULL) AS nulls, count(DISTINCT lang) AS distinct FROM documents UNION ALL SELECT 'source', count(*) FILTER (source IS NULL), count(DISTINCT source) FROM documents")
def column_profile(spark, sf_dir):
    return S.profile(table(spark, sf_dir, "documents").select("lang", "source")).select("column", "nulls", "distinct")


WINDOWED = f"""SELECT date_trunc('hour', ts) AS window_start, strategy, count(*) AS n, count(error) AS errors, round(sum(CAST(round(latency_ms * 100) AS BIGINT)) / count(*) / 100, 6)::DOUBLE AS mean_ms FROM {LOG} GROUP BY 1, 2"""


@query("log_windows", WINDOWED)
def log_windows(spark, sf_dir):
    return windowed(log(spark, sf_dir), "strategy")


@query("log_windows_stream", f"SELECT * FROM ({WINDOWED}) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def log_windows_stream(spark, sf_dir):
    """The finished windows of a stream of the events' files, run until all is read: each is written once, and state behind the watermark goes."""
    path = files.workspace(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*events.parquet").parquet(sf_dir)
    to_parquet(windowed(entries(stream), "strategy"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out")
