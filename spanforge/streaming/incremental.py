"""Streams: windows over events with late data, and tables refreshed batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(
    events: DataFrame, size: str, slide: str | None = None, late: str | None = "1 hour", at: str = "ts", by: str = "event_type", value: str = "value"
) -> DataFrame:
    """(start, end, by, n, total) of tumbling or sliding windows; rows later than `late` are left out of a stream."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    if late and events.isStreaming:
        rows = rows.withWatermark(at, late)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return rows.groupBy(w, by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", "total"
    )


def sessions(events: DataFrame, gap: str, late: str | None = "1 hour", at: str = "ts", by: str = "user_id") -> DataFrame:
    """(by, start, end, n) of runs of events without a longer pause than `gap`."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    if late and events.isStreaming:
        rows = rows.withWatermark(at, late)
    return rows.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(
        by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a step on every batch that there is, once each, and ends; the finished query."""
    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
