"""A store of log entries by day: appended to by a stream, compacted by day, its old days dropped as folders.

Layout: ``day=<date>/merged=<0|1>/batch=<number>`` in Parquet. A batch that a stream repeats overwrites its own folders, so each entry is
there once. A merged folder of a day stands for all its batches up to its number; readers leave those out, so that it takes their place the
moment it is there, and ``sweep`` deletes them later. One stream, whose batch numbers grow, writes to a store. Days are those of UTC; entries without a time have no day
and stay until they are deleted by hand.
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuslode.sources.files import LOG_SCHEMA, log_entry

PLACE = ("day", "merged", "batch")
FILE_ROWS = 1_000_000


def _write(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(path)


def append(entries: DataFrame, path: str, batch: int) -> None:
    """The entries of a batch, without a shuffle; the same batch again takes the place of the first."""
    day = F.date_from_unix_date(F.floor(F.col("ts") / 86400).cast("int"))
    _write(log_entry(entries).select(*[c.strip().split()[0] for c in LOG_SCHEMA.split(",")], day.alias("day"), F.lit(0).alias("merged"), F.lit(batch).cast("long").alias("batch")), path)


def append_stream(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return entries.writeStream.foreachBatch(lambda df, i: append(df, path, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _placed(spark: SparkSession, path: str) -> DataFrame:
    every = spark.read.schema(f"{LOG_SCHEMA}, day date, merged int, batch long").parquet(path)
    upto = every.where("merged = 1").groupBy(F.col("day").alias("__day")).agg(F.max("batch").alias("__upto"))
    upto = F.broadcast(upto)  # a row for each day
    live = F.when(F.col("merged") == 1, F.col("batch") == F.col("__upto")).otherwise(F.col("__upto").isNull() | (F.col("batch") > F.col("__upto")))
    return every.join(upto, F.col("day").eqNullSafe(F.col("__day")), "left").where(live).drop("__day", "__upto")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Each entry once, with its day, by which a filter prunes folders."""
    return _placed(spark, path).drop("merged", "batch")


def compact(spark: SparkSession, path: str, file_rows: int = FILE_ROWS) -> None:
    """Days of several folders are written as one, in files of about ``file_rows`` entries each, by many tasks if a day is large.

    The newest batch is left alone, as its stream can still repeat it.
    """
    live = _placed(spark, path)
    newest = live.where("merged = 0").agg(F.max("batch")).first()[0]
    if newest is None:
        return
    ready = live.where(F.col("batch") < newest)
    days = ready.groupBy(*PLACE).agg(F.count("*").alias("n")).groupBy("day").agg(F.count("*").alias("folders"), F.sum("n").alias("n"), F.max("batch").alias("upto"))
    days = days.where("folders > 1").select(F.col("day").alias("__day"), "upto", F.ceil(F.col("n") / file_rows).alias("files"))
    rows = ready.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("__place"))
    rows = rows.join(F.broadcast(days), F.col("day").eqNullSafe(F.col("__day")))  # a row for each day
    rows = rows.withColumn("merged", F.lit(1)).withColumn("batch", F.col("upto")).repartition("day", F.pmod("__place", "files"))
    _write(rows.drop("__day", "__place", "upto", "files"), path)


def _folders(spark: SparkSession, path: str, pattern: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, [s.getPath() for s in system.globStatus(at) or ()]


def sweep(spark: SparkSession, path: str) -> int:
    """Folders that a merged one stands for are deleted; nobody should still be reading from before the compaction."""
    system, found = _folders(spark, path, "day=*/merged=*/batch=*")
    placed = [(*re.search(r"/day=([^/]*)/merged=(\d)/batch=(\d+)$", p.toString()).groups(), p) for p in found]
    upto: dict[str, int] = {}
    for day, merged, batch, _ in placed:
        if merged == "1":
            upto[day] = max(upto.get(day, -1), int(batch))
    old = [p for day, merged, batch, p in placed if int(batch) < upto.get(day, -1) or (merged == "0" and int(batch) == upto.get(day))]
    for p in old:
        system.delete(p, True)
    return len(old)


def drop_days(spark: SparkSession, path: str, before: datetime.date) -> int:
    """Folders of days before the given one are deleted; no entry is read."""
    system, found = _folders(spark, path, "day=*")
    old = [p for p in found if re.fullmatch(r"day=\d{4,}-\d\d-\d\d", p.getName()) and datetime.date.fromisoformat(p.getName()[4:]) < before]
    for p in old:
        system.delete(p, True)
    return len(old)
