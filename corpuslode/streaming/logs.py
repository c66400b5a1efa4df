"""Retrieval-log statistics over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(log: DataFrame, by: str, time: str = "ts", width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Entries, errors and latency of each window and key; entries that come later than ``late`` are left out.

    Works on a stream and, with the same result for entries in time, on a table.
    """
    kind = dict(log.dtypes)[time]
    log = log.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need one with a zone
    df = log.withWatermark(time, late) if log.isStreaming else log
    window: Column = F.window(time, width, slide) if slide else F.window(time, width)
    cents = F.sum(F.round(F.col("latency_ms") * 100).cast("long"))
    out = df.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"), cents.alias("cents"))
    return out.select(F.col("w.start").cast(kind).alias("window_start"), by, "n", "errors", F.round(F.col("cents") / F.col("n") / 100, 6).alias("mean_ms"))


def to_parquet(stats: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished windows, once each: the sink and the checkpoint together make it exactly once."""
    return stats.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
