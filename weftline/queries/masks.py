from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import masks as M

from .base import IMG, Views, query, rounded

_PTS = """pts AS (SELECT cast(l_orderkey AS VARCHAR) AS image_id, cast(l_quantity AS INTEGER) % 20 AS row, cast(l_suppkey % 24 AS INTEGER) AS col,
cast(l_partkey % 6 AS INTEGER) AS value, l_linenumber * 1000000 + l_partkey AS position FROM lineitem)"""
_PIX = f"""{_PTS}, pix AS (SELECT image_id, r AS row, c AS col, arg_max(value, position) AS value FROM
(SELECT image_id, value, position, unnest(generate_series(greatest(row - 2, 0), least(row + 2, 20) - 1)) AS r, c0, c1 FROM
    (SELECT *, greatest(col - 2, 0) AS c0, least(col + 2, 24) - 1 AS c1 FROM pts WHERE value > 1)) x, generate_series(c0, c1) g(c) GROUP BY 1, 2, 3)"""



def _pixels(v):
    points = v.lineitem.select(
        F.col("l_orderkey").cast("string").alias("image_id"), (F.col("l_quantity").cast("int") % 20).alias("row"), (F.col("l_suppkey") % 24).cast("int").alias("col"),
        F.concat(F.lit("L"), (F.col("l_partkey") % 6).cast("string")).alias("source_label_name"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("position"),
    )
    images = v.orders.select(F.col("o_orderkey").cast("string").alias("image_id"), F.lit(20).alias("height"), F.lit(24).alias("width"))
    ids = v.spark.range(2, 6).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("source_label_name"), F.col("id").cast("int").alias("value"))
    return M.rasterise(points, images, ids, padding=2)


@query(f"WITH {_PIX} SELECT image_id, cast(row AS INTEGER) AS row, cast(col AS INTEGER) AS col, cast(value + 100 AS INTEGER) AS value FROM pix")
def mask_rasterise(spark, sf_dir):
    return _pixels(Views(spark, sf_dir)).withColumn("value", M.shifted(F.col("value"), 100))


@query(f"WITH {_PIX}, c AS (SELECT value, count(*) AS n FROM pix GROUP BY 1) SELECT value, n, round(n / sum(n) OVER (), 6) AS share FROM c")
def pixel_counts(spark, sf_dir):
    return M.pixel_counts(_pixels(Views(spark, sf_dir))).withColumn("share", rounded("share"))


@query(f"WITH {_PIX} SELECT DISTINCT image_id, cast(row // 8 * 8 AS VARCHAR) || '_' || cast(col // 8 * 8 AS VARCHAR) AS tile_id, value FROM pix")
def tile_classes(spark, sf_dir):
    return M.tile_classes(_pixels(Views(spark, sf_dir)), ["image_id"], 8)


@query(f"""WITH {IMG} SELECT image_id, y0 || '_' || x0 AS tile_id, cast(y0 AS INTEGER) AS y0, cast(x0 AS INTEGER) AS x0, cast(least(2048, height - y0) AS INTEGER) AS tile_height, cast(least(2048, width - x0) AS INTEGER) AS tile_width
FROM img, generate_series(0, height - 1, 2048) a(y0), generate_series(0, width - 1, 2048) b(x0) WHERE width IS NOT NULL""")
def tile_grid(spark, sf_dir):
    return M.tile_grid(Views(spark, sf_dir).img, ["image_id"])
