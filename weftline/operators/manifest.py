"""Image and training manifests over a latest-run-wins checkpoint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import resized_key

KEY = ("source_id", "image_id")
MAX_EDGE = 2048


def latest_rows(runs: Sequence[DataFrame], keys: Sequence[str] = KEY, time: str = "resize_timestamp") -> DataFrame:
    """One row per key over several runs: a timed row beats an untimed one, then the
    later time, then the later run."""
    if not runs:
        raise ValueError("no runs")
    numbered = [r.withColumn("_run", F.lit(i)) for i, r in enumerate(runs)]
    every = numbered[0]
    for r in numbered[1:]:
        every = every.unionByName(r, allowMissingColumns=True)
    return newest(every, keys, [F.col(time).desc_nulls_last(), F.col("_run").desc()]).drop("_run")


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def longest_edge(w: Column, h: Column) -> Column:
    """Null unless both dimensions are known."""
    return F.when(w.isNotNull() & h.isNotNull(), F.greatest(w, h))


def needs_resize(w: Column, h: Column, most: int = MAX_EDGE) -> Column:
    return F.coalesce(longest_edge(w, h), F.lit(0)) > most


def scaled(edge: Column, longest: Column, most: int = MAX_EDGE) -> Column:
    """An edge after the longest is brought to ``most``, rounded down."""
    return F.floor(edge.cast("double") * (F.lit(float(most)) / longest)).cast("int")


def resized(edge: Column, w: Column, h: Column, most: int = MAX_EDGE) -> Column:
    longest = longest_edge(w, h)
    return F.when(longest > most, scaled(edge, longest, most)).otherwise(edge)


def resize_manifest(images: DataFrame, checkpoint: DataFrame, prefix: str = "data", most: int = MAX_EDGE) -> DataFrame:
    """Images that the checkpoint has a status for, with original and resized dimensions, key, time and status."""
    done = checkpoint.where("status is not null").select(*KEY, "status", "resize_timestamp")
    w, h = F.col("width"), F.col("height")
    return images.select(*KEY, "width", "height").join(done, list(KEY)).select(
        *KEY, w.alias("original_width"), h.alias("original_height"),
        resized(w, w, h, most).alias("resized_width"), resized(h, w, h, most).alias("resized_height"),
        resized_key(prefix, F.col("source_id"), F.col("image_id")).alias("output_s3_key"), "resize_timestamp", "status",
    )


def image_manifest(images: DataFrame, checkpoint: DataFrame, prefix: str = "data", most: int = MAX_EDGE) -> DataFrame:
    """What to load for each usable image: its key and its dimensions then.

    An image that needs resizing is usable once its resize is completed; one
    without known positive dimensions never is. Load dimensions shrink wherever
    the resized file is used; any other image keeps the key ``s3_key`` it is stored under.
    """
    rows = images.join(checkpoint.select(*KEY, "status"), list(KEY), "left")
    use = F.col("needs_resize") & (F.coalesce("status", F.lit("")) == "completed")
    w, h = F.col("width"), F.col("height")
    longest = F.greatest(w, h)
    usable = (~F.col("needs_resize") | F.col("uses_resized_image")) & (w > 0) & (h > 0)
    rows = rows.withColumn("uses_resized_image", use).where(usable)
    load = lambda edge: F.when(F.col("uses_resized_image"), scaled(edge, longest, most)).otherwise(edge)
    key = F.when(F.col("uses_resized_image"), resized_key(prefix, F.col("source_id"), F.col("image_id"))).otherwise(F.col("s3_key"))
    return rows.select(*KEY, "width", "height", load(w).alias("load_width"), load(h).alias("load_height"), key.alias("image_s3_key"), "uses_resized_image")


def rescaled(at: Column, load: Column, original: Column) -> Column:
    """A coordinate on the loaded image, clamped to it."""
    moved = F.floor(at * (load / original))
    return F.greatest(F.least(moved, load - 1), F.lit(0)).cast("smallint")


def training_manifest(annotations: DataFrame, images: DataFrame, checkpoint: DataFrame, prefix: str = "data", most: int = MAX_EDGE) -> DataFrame:
    """Annotations on usable images, in the coordinates of the file to load."""
    usable = image_manifest(images, checkpoint, prefix, most)
    points = annotations.select(*KEY, "row", "col", "label_id")
    return points.join(usable, list(KEY)).select(
        *KEY,
        rescaled(F.col("row"), F.col("load_height"), F.col("height")).alias("row"),
        rescaled(F.col("col"), F.col("load_width"), F.col("width")).alias("col"),
        "label_id", F.col("label_id").cast("string").alias("source_label_name"), "image_s3_key",
        F.col("load_width").cast("smallint").alias("load_width"), F.col("load_height").cast("smallint").alias("load_height"),
        "uses_resized_image",
    )
