"""A resumable work queue: what is left to do, what was done, what is unexplained."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import image_key, resized_key

from .manifest import KEY

CHECKPOINT = "source_id int, image_id string, status string, resize_timestamp timestamp_ntz, error_message string, skip_reason string"


class StaleCheckpoint(ValueError):
    """Pending items that no image of the todo list matches."""


def todo_from_listing(images: DataFrame, listed: DataFrame, prefix: str = "data") -> DataFrame:
    """Images to resize whose resized key is not in the listing (column key)."""
    rows = images.where("needs_resize").withColumn("key", resized_key(prefix, F.col("source_id"), F.col("image_id")))
    return rows.join(listed.select("key"), "key", "left_anti").select(*KEY, "width", "height", F.col("key").alias("resized_key"))


def unseen(items: DataFrame, seen: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return items.join(seen.select(*keys), list(keys), "left_anti")


def with_source_key(items: DataFrame, images: DataFrame, prefix: str = "data") -> DataFrame:
    """Items that an image matches, once per image, with the (least) stored key or the template's."""
    stored = F.col("s3_key") if "s3_key" in images.columns else F.lit(None).cast("string")
    known = images.groupBy(*KEY).agg(F.min(stored).alias("s3_key"))
    key = F.coalesce("s3_key", image_key(prefix, F.col("source_id"), F.col("image_id")))
    return items.join(known, list(KEY)).withColumn("s3_key", key)


def pending(checkpoint: DataFrame) -> DataFrame:
    return checkpoint.where("status = 'pending'")


def resume(checkpoint: DataFrame, todo: DataFrame) -> DataFrame:
    """Pending items with their todo row; an error if there are some and none matches."""
    left = pending(checkpoint).select(*KEY)
    found = left.join(todo, list(KEY))
    if found.isEmpty() and not left.isEmpty():
        raise StaleCheckpoint("pending items match no image")
    return found


def new_checkpoint(todo: DataFrame) -> DataFrame:
    blank = lambda t: F.lit(None).cast(t)
    return todo.select(
        *KEY, F.lit("pending").alias("status"), blank("timestamp_ntz").alias("resize_timestamp"),
        blank("string").alias("error_message"), blank("string").alias("skip_reason"),
    )


def apply_results(checkpoint: DataFrame, results: DataFrame) -> DataFrame:
    """Upsert: a result's values replace the checkpoint's, but its nulls never do."""
    fields = [c for c in checkpoint.columns if c not in KEY]
    new = results.select(*KEY, *[F.col(c).alias(f"_{c}") for c in fields if c in results.columns])
    both = checkpoint.join(new, list(KEY), "full")
    return both.select(*KEY, *[F.coalesce(f"_{c}", c).alias(c) if c in results.columns else F.col(c) for c in fields])


def is_corrupted(reason: Column) -> Column:
    return F.coalesce(reason.startswith("corrupted_"), F.lit(False))


def checkpoint_summary(checkpoint: DataFrame) -> DataFrame:
    """Completed, failed, and skipped items, the corrupt ones apart; one pass."""
    reason = F.col("skip_reason") if "skip_reason" in checkpoint.columns else F.lit(None).cast("string")
    s = F.col("status")
    return checkpoint.agg(
        F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"),
        F.count_if((s == "skipped") & is_corrupted(reason)).alias("skipped_corrupted"),
        F.count_if((s == "skipped") & ~is_corrupted(reason)).alias("skipped_other"),
    )
