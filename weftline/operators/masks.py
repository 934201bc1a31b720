"""Point annotations as pixel masks, in sparse form; tiling geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rasterise(points: DataFrame, images: DataFrame, ids: DataFrame, padding: int = 0, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Labelled pixels (keys, row, col, value).

    A point colours its pixel, or with padding p the square [r - p, r + p) by
    [c - p, c + p), cut at the image's edges; of points on one pixel the one with
    the greatest ``position`` counts. ``ids`` maps source_label_name to value;
    points with other or null labels colour nothing.
    """
    rows = points.join(ids.select("source_label_name", "value"), "source_label_name").join(images.select(*keys, "height", "width"), list(keys))
    if padding:
        first = lambda c: F.greatest(F.col(c) - padding, F.lit(0))
        last = lambda c, size: F.least(F.col(c) + padding, F.col(size)) - 1
    else:
        first, last = (lambda c: F.greatest(F.col(c), F.lit(0))), (lambda c, size: F.least(F.col(c), F.col(size) - 1))
        rows = rows.where("row >= 0 and col >= 0 and row < height and col < width")
    rows = rows.withColumns({"r0": first("row"), "r1": last("row", "height"), "c0": first("col"), "c1": last("col", "width")})
    rows = rows.where("r0 <= r1 and c0 <= c1")
    rows = rows.withColumn("r", F.explode(F.sequence("r0", "r1"))).withColumn("c", F.explode(F.sequence("c0", "c1")))
    last_value = F.max_by("value", "position").alias("value")
    return rows.groupBy(*keys, F.col("r").alias("row"), F.col("c").alias("col")).agg(last_value)


def shifted(value: Column, offset: int | Column) -> Column:
    """Global id of a local one; background stays 0."""
    return F.when(value > 0, value + offset).otherwise(value)


def tile_grid(images: DataFrame, keys: Sequence[str], tile: int = 2048) -> DataFrame:
    """Tiles that cover each image, cut at its edges, named y0_x0."""
    starts = lambda size: F.sequence(F.lit(0), F.col(size) - 1, F.lit(tile))
    rows = images.where("height > 0 and width > 0").withColumn("y0", F.explode(starts("height"))).withColumn("x0", F.explode(starts("width")))
    return rows.select(
        *keys, F.concat_ws("_", F.col("y0").cast("string"), F.col("x0").cast("string")).alias("tile_id"), "y0", "x0",
        F.least(F.lit(tile), F.col("height") - F.col("y0")).alias("tile_height"), F.least(F.lit(tile), F.col("width") - F.col("x0")).alias("tile_width"),
    )


def pixel_counts(pixels: DataFrame, value: str = "value") -> DataFrame:
    """Pixels of each value and the share among those that are not background."""
    from pyspark.sql import Window

    counts = pixels.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    fore = F.when(F.col(value) != 0, F.col("n"))
    return counts.withColumn("share", fore / F.sum(fore).over(Window.partitionBy(F.lit(1))))


def tile_classes(pixels: DataFrame, keys: Sequence[str], tile: int, value: str = "value") -> DataFrame:
    """Distinct classes present in each tile, background left out."""
    at = lambda c: (F.floor(F.col(c) / tile) * tile).cast("int")
    tile_id = F.concat_ws("_", at("row").cast("string"), at("col").cast("string")).alias("tile_id")
    return pixels.where(F.col(value) != 0).select(*keys, tile_id, value).distinct()
