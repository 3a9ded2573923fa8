"""Structured Streaming ingestion: new documents into an index, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.sources.files import exists


def append_documents(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Append each micro-batch of new documents (id, ...) to Parquet; ids that are there stay as they are.

    A batch has a folder of its own, which is written anew if the batch is repeated, and is compared with the ids of
    the other folders only, so a repeated batch leaves the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows, spark = transform(batch.dropDuplicates(["id"])), batch.sparkSession
        if exists(spark, path):
            rows = rows.join(spark.read.parquet(path).filter(F.col("batch") != number).select("id"), "id", "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) in tumbling windows; works on streams and tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
