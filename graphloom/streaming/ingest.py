"""Incremental ingestion by Structured Streaming: file batches merged into a versioned store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.knowledge import empty_store, merge_batch


def stream_merge(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str) -> None:
    """Merges every new file of relations (head, type, tail, provs) under ``source`` into the store at ``store``.

    The store is a folder per batch; a repeated batch overwrites its own
    version, so a restart after a failure merges once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        base = spark.read.parquet(f"{store}/v{number - 1}") if number else empty_store(batch)
        merge_batch(base, batch, f"v{number}").write.mode("overwrite").parquet(f"{store}/v{number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type, for streams (with a watermark) and tables alike."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
