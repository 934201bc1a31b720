"""Registration, and the domain's shapes as views of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL of its result."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


class Views:
    """The driver's tables, and annotations, images, runs and splits made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def ann(self) -> DataFrame:
        return self.lineitem.select(
            (F.col("l_orderkey") % 50).cast("int").alias("source_id"),
            F.col("l_orderkey").cast("string").alias("image_id"),
            (F.col("l_linenumber") * 100).alias("row"),
            (F.col("l_quantity").cast("int") * 10).alias("col"),
            (F.col("l_partkey") % 40).cast("int").alias("label_id"),
            (F.col("l_orderkey") % 10).alias("tenth"),
        )

    @property
    def img(self) -> DataFrame:
        k = F.col("o_orderkey")
        known = k % 97 != 0
        w = F.when(known, (500 + (k * 37) % 4000).cast("int"))
        h = (400 + (k * 53) % 3000).cast("int")
        return self.orders.select(
            (k % 50).cast("int").alias("source_id"), k.cast("string").alias("image_id"),
            F.concat(F.lit("raw/"), k.cast("string"), F.lit(".JPG")).alias("s3_key"), w.alias("width"), h.alias("height"),
            (known & (F.greatest(w, h) > 2048)).alias("needs_resize"), (k % 10).alias("tenth"),
        )

    @property
    def runs(self) -> list[DataFrame]:
        k, status = F.col("o_orderkey"), F.col("o_orderstatus")
        key = [(k % 50).cast("int").alias("source_id"), k.cast("string").alias("image_id")]
        first = self.orders.select(
            *key, F.when(status == "F", "completed").when(status == "O", "failed").otherwise("skipped").alias("status"),
            F.when(status == "F", F.col("o_orderdate")).alias("resize_timestamp"),
        )
        second = self.orders.where(k % 2 == 0).select(
            *key, F.when(k % 3 == 0, "completed").otherwise("failed").alias("status"),
            F.when(k % 3 == 0, F.col("o_orderdate")).alias("resize_timestamp"),
        )
        return [first, second]


#: The same views as SQL, for WITH clauses.
ANN = """ann AS (SELECT cast(l_orderkey % 50 AS INTEGER) AS source_id, cast(l_orderkey AS VARCHAR) AS image_id,
    l_linenumber * 100 AS row, cast(trunc(l_quantity) AS INTEGER) * 10 AS col, cast(l_partkey % 40 AS INTEGER) AS label_id,
    l_orderkey % 10 AS tenth FROM lineitem)"""
IMG = """img AS (SELECT *, width IS NOT NULL AND greatest(width, height) > 2048 AS needs_resize FROM (
    SELECT cast(o_orderkey % 50 AS INTEGER) AS source_id, cast(o_orderkey AS VARCHAR) AS image_id, 'raw/' || o_orderkey || '.JPG' AS s3_key,
    CASE WHEN o_orderkey % 97 <> 0 THEN cast(500 + (o_orderkey * 37) % 4000 AS INTEGER) END AS width,
    cast(400 + (o_orderkey * 53) % 3000 AS INTEGER) AS height, o_orderkey % 10 AS tenth FROM orders))"""
RUNS = """runs AS (SELECT cast(o_orderkey % 50 AS INTEGER) AS source_id, cast(o_orderkey AS VARCHAR) AS image_id,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'skipped' END AS status,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS resize_timestamp, 0 AS run FROM orders
    UNION ALL SELECT cast(o_orderkey % 50 AS INTEGER), cast(o_orderkey AS VARCHAR),
    CASE WHEN o_orderkey % 3 = 0 THEN 'completed' ELSE 'failed' END,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END, 1 FROM orders WHERE o_orderkey % 2 = 0)"""
LATEST = """latest AS (SELECT source_id, image_id, status, resize_timestamp FROM (SELECT *, row_number() OVER (
    PARTITION BY source_id, image_id ORDER BY resize_timestamp DESC NULLS LAST, run DESC) AS k FROM runs) WHERE k = 1)"""


def split_of(tenth):
    return F.when(tenth < 6, "train").when(tenth < 8, "val").otherwise("test")


SPLIT = "CASE WHEN tenth < 6 THEN 'train' WHEN tenth < 8 THEN 'val' ELSE 'test' END"


def rounded(c, digits: int = 6):
    return (F.round(c, digits) + F.lit(0.0))
