"""Streams of records: lazily read, taken and skipped, shuffled by micro-batch, resumed from checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def run(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str):
    """Process what is there, once for each file; a later call with the checkpoint takes up after it."""
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_to(path: str, transform: Callable[[DataFrame], DataFrame] = lambda x: x) -> Callable[[DataFrame, int], None]:
    """Batches into folders named by their number: one that is done again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def shuffled(key: str, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """Shuffle within a micro-batch (the buffer of a stream)."""
    return lambda batch: batch.orderBy(F.xxhash64(key, F.lit(seed)), key)


def windowed_counts(events: DataFrame, time: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by time window; rows later than ``late`` are left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", by, "n", "total")
