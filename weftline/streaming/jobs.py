"""Restartable jobs as streams that end when their input does.

The batch behaviours are resumable by checkpoint files; these are the same
semantics on Structured Streaming's own checkpoints. They are extensions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.manifest import KEY, newest


def process_new_files(
    spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]
) -> None:
    """Apply ``work`` to rows of files not seen before and append the results; then stop."""
    rows = spark.readStream.schema(schema).parquet(source)
    stream = work(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    stream.start(sink).awaitTermination()


def append_results(spark: SparkSession, source: str, schema: str, events: str, checkpoint: str) -> None:
    """Worker results as an append-only event table, a batch number on each row; replays overwrite their batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_id", F.lit(number)).write.mode("overwrite").parquet(f"{events}/batch={number:08d}")

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(put)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_state(events: DataFrame) -> DataFrame:
    """The latest row of each key in the event table."""
    return newest(events, KEY, [F.col("resize_timestamp").desc_nulls_last(), F.col("batch_id").desc()])


def distinct_exports(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First rows of keys, of a stream whose repeats come within the delay."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, time: str, width: str, delay: str, key: str) -> DataFrame:
    """Counts per event-time window and key; later rows than the delay drop out."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
