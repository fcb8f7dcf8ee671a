"""Structured Streaming: late-aware counts and an idempotent sink into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators.store import Store


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """A stream of events (ts, event_type) -> counts per window, final once the watermark has passed."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))


def into_store(spark: SparkSession, pages: DataFrame, store: Store, table: str, checkpoint: str):
    """Upserts every batch of a stream of pages; a batch that is delivered twice changes nothing the second time."""

    def put(batch: DataFrame, _: int) -> None:
        store.upsert(table, batch)

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
