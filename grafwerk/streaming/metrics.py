"""Streams: tool metrics by window, sessions, and change feeds into the built graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_metrics(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Calls and errors by tool and window; state goes once the watermark passes it."""
    rows = events if not events.isStreaming else events.withWatermark("at", late)
    return rows.groupBy(F.window("at", width).alias("w"), "tool").agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("errors")).select(F.col("w.start").alias("start"), "tool", "calls", "errors")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    rows = events if not events.isStreaming else events.withWatermark("at", late)
    return rows.groupBy(F.session_window("at", gap).alias("w"), "session").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "session", "events")


def apply_changes(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint_dir: str) -> StreamingQuery:
    """Feed micro-batches of a change stream to a function until what is there is read."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
