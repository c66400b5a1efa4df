"""Markdown files, embedding snapshots, JSONL and retrieval logs as sources and sinks.

All reading and writing is Spark's, so any file system will do.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslode.operators.metadata import content_types, extract_deed, extract_profile, truncate

BATCH_FILES = 20


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, or for a local session without one a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="corpuslode-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# What a snapshot's folder may be called.
SNAPSHOT = "batch_ts"


def read_markdown(spark: SparkSession, path: str, profiles: bool = False) -> DataFrame:
    """A row per file: text, what the file system tells, fields, content labels and id."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("modified"),
    )
    return described(raw, profiles)


def described(raw: DataFrame, profiles: bool = False) -> DataFrame:
    """Files (text, file_path, file_name, file_size, modified) with fields, content labels and id."""
    own = F.nullif(F.regexp_extract("file_name", r"(deed_[0-9A-Fa-f]+)\.md$", 1), F.lit(""))
    record = F.nullif(F.regexp_extract("text", r"Record ID:\s*(\d+)", 1), F.lit(""))
    fields = extract_profile(F.col("text")) if profiles else extract_deed(F.col("text"))
    return raw.select(F.coalesce(record if profiles else own, F.regexp_replace("file_name", r"\.md$", "")).alias("file_doc_id"), "*", content_types(F.col("text")).alias("content_types"), F.struct(*fields).alias("fields"))


def in_batches(files: DataFrame, size: int = BATCH_FILES, by: str = "file_path") -> DataFrame:
    """Numbers of batches of ``size`` files in the order of their paths.

    The paths alone pass the one ordered window; texts stay where they are.
    """
    order = files.select(by).distinct().withColumn("batch_number", (F.floor((F.row_number().over(Window.orderBy(by)) - 1) / size) + 1).cast("int"))
    return files.join(order, by)


def write_jsonl(docs: DataFrame, path: str, priority: Sequence[str] = ()) -> None:
    """Id, text, metadata and the fields that matter for embedding, one JSON object a line."""
    first = F.map_filter("metadata", lambda k, v: k.isin(*priority)) if priority else F.create_map().cast("map<string,string>")
    docs.select(F.col("doc_id").alias("id"), "text", "metadata", first.alias("embedding_priority_fields")).write.json(path)


def safe_name(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(c), r"[^\p{L}\p{M}\p{N}_-]+", "_"), F.lit("")), F.lit("unknown"))


def write_markdown(docs: DataFrame, path: str, group: str = "province", id_col: str = "doc_id") -> None:
    """Each document as a file in a folder of its own, for few documents; ``markdown_sink.write`` is for many."""
    name = safe_name(F.col(id_col).cast("string"))
    docs.select(safe_name(F.col(group)).alias("folder"), name.alias("document"), "text").write.partitionBy("folder", "document").option("lineSep", "\n").text(path)


def read_markdown_folders(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_markdown`` wrote: folder, document and text, without the line's end that closes a file."""
    files = spark.read.text(f"{path}/*/*/*.txt", wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    part = lambda name: F.url_decode(F.regexp_extract("p", rf"/{name}=([^/]*)/", 1)).alias(name)
    return files.select(part("folder"), part("document"), F.regexp_replace("value", r"\n\z", "").alias("text"))


def markdown_index(docs: DataFrame, group: str = "province", first: int = 10) -> DataFrame:
    """Of each group its size and its first documents; only these are put in order."""
    place = F.row_number().over(Window.partitionBy(group).orderBy("doc_id"))
    some = docs.withColumn("i", place).where(F.col("i") <= first)
    some = some.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("doc_id", truncate(F.col("text"), 80).alias("line")))).alias("documents"))
    sizes = docs.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("n"))
    return sizes.join(some, F.col("__g").eqNullSafe(F.col(group))).select(group, "n", "documents")


def write_snapshot(embeddings: DataFrame, path: str, stamp: str) -> None:
    """One Parquet table, a folder for each batch and type."""
    out = embeddings.withColumn(SNAPSHOT, F.lit(stamp)).withColumn("preview", F.slice("embedding", 1, 5))
    out.write.mode("append").partitionBy(SNAPSHOT, "batch_number", "type").parquet(path)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The stamps there are, in order."""
    return spark.read.parquet(path).select(SNAPSHOT).distinct().orderBy(SNAPSHOT)


def read_snapshot(spark: SparkSession, path: str, types: Sequence[str] | None = None, batch: int | None = None, stamp: str | None = None) -> DataFrame:
    """The latest or the given snapshot, pruned to types and batch by its folders."""
    df = spark.read.parquet(path)
    if stamp is None:
        df = df.join(F.broadcast(df.agg(F.max(SNAPSHOT).alias(SNAPSHOT))), SNAPSHOT)  # one row
    else:
        df = df.where(F.col(SNAPSHOT) == stamp)
    df = df.where(F.col("type").isin(*types)) if types else df
    return df.where(F.col("batch_number") == batch) if batch is not None else df


LOG_SCHEMA = "timestamp string, ts double, query string, index string, strategy string, latency_ms double, prompt_tokens long, completion_tokens long, total_tokens long, confidence double, error string"


def log_entry(log: DataFrame) -> DataFrame:
    """Entries as they are stored, times to two and confidence to three places."""
    return log.withColumn("latency_ms", F.round("latency_ms", 2)).withColumn("confidence", F.round("confidence", 3)).withColumn("total_tokens", F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))


def append_log(log: DataFrame, path: str) -> None:
    """Append; files are compressed, and compaction takes the place of rotation."""
    log_entry(log).write.mode("append").option("compression", "gzip").json(path)


def compact_log(spark: SparkSession, source: str, target: str, files: int = 1) -> None:
    read_log(spark, source).coalesce(files).write.mode("overwrite").option("compression", "gzip").json(target)


def read_log(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Plain and compressed entries, without malformed lines, latest first if limited."""
    log = spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return log if limit is None else log.orderBy(F.desc("ts")).limit(limit)


def kept_log(log: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """Entries of the last ``days`` days."""
    return log.where(F.timestamp_seconds("ts") >= (now if now is not None else F.current_timestamp()) - F.make_dt_interval(F.lit(days)))


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """S31."""
    return spark.read.schema("query string, expected_index string").json(path)
