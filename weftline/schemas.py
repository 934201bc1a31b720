"""Declared tables, their keys, and checks that operators and sinks share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The declared tables; the last argument of a field is whether it may be null.
AUDIT = T.StructType(
    [
        T.StructField("source_id", T.IntegerType(), False),
        T.StructField("audit_timestamp", T.TimestampType(), False),
        T.StructField("has_images_folder", T.BooleanType(), False),
        T.StructField("has_annotations_csv", T.BooleanType(), False),
        T.StructField("has_image_list_csv", T.BooleanType(), False),
        T.StructField("has_labelset_csv", T.BooleanType(), False),
        T.StructField("has_metadata_csv", T.BooleanType(), False),
        T.StructField("n_images_s3", T.LongType(), False),
        T.StructField("n_images_csv", T.LongType(), False),
        T.StructField("n_annotations", T.LongType(), False),
        T.StructField("n_unique_images_annotated", T.LongType(), False),
        T.StructField("n_labels", T.LongType(), True),
        T.StructField("n_metadata_rows", T.LongType(), True),
        T.StructField("annotations_empty", T.BooleanType(), False),
        T.StructField("image_list_empty", T.BooleanType(), False),
        T.StructField("labelset_empty", T.BooleanType(), False),
        T.StructField("metadata_empty", T.BooleanType(), False),
        T.StructField("annotations_csv_read_failed", T.BooleanType(), False),
        T.StructField("image_list_csv_read_failed", T.BooleanType(), False),
        T.StructField("labelset_csv_read_failed", T.BooleanType(), False),
        T.StructField("metadata_csv_read_failed", T.BooleanType(), False),
        T.StructField("is_complete", T.BooleanType(), False),
        T.StructField("image_count_match", T.BooleanType(), False),
        T.StructField("image_list_covers_annotations", T.BooleanType(), False),
        T.StructField("errors", T.ArrayType(T.StringType()), True),
    ]
)
ANNOTATIONS = T.StructType(
    [
        T.StructField("source_id", T.IntegerType(), False),
        T.StructField("image_id", T.StringType(), False),
        T.StructField("row", T.IntegerType(), False),
        T.StructField("col", T.IntegerType(), False),
        T.StructField("label_id", T.IntegerType(), False),
        T.StructField("status", T.StringType(), True),
    ]
)
IMAGES = T.StructType(
    [
        T.StructField("source_id", T.IntegerType(), False),
        T.StructField("image_id", T.StringType(), False),
        T.StructField("s3_key", T.StringType(), False),
        T.StructField("width", T.IntegerType(), True),
        T.StructField("height", T.IntegerType(), True),
        T.StructField("longest_edge", T.IntegerType(), True),
        T.StructField("file_size", T.LongType(), True),
        T.StructField("needs_resize", T.BooleanType(), False),
        T.StructField("header_status", T.StringType(), False),
        T.StructField("error_message", T.StringType(), True),
    ]
)
KEYS = {"audit": ("source_id",), "annotations": ("source_id", "image_id", "row", "col"), "images": ("source_id", "image_id")}


class SchemaError(ValueError):
    """Columns or values that a declared table must not have."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return df


def validate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Every declared column must be there; others may be."""
    return require_columns(df, schema.fieldNames())


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns only, in order and cast."""
    return validate(df, schema).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def required_nulls(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row: how many nulls each required column holds."""
    return df.agg(*[F.count_if(F.col(f.name).isNull()).alias(f.name) for f in schema if not f.nullable])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
