"""Writers: sorted single files with a content digest, parts, atomic checkpoints, reports."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.schemas import conform


def digest(df: DataFrame) -> str:
    """A digest of the rows whatever their order or files; equal tables have equal digests."""
    columns = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in sorted(df.columns)]
    h = F.xxhash64(*columns)
    row = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return ":".join(str(x) for x in row)


def write_sorted(df: DataFrame, path: str, schema: T.StructType, keys: Sequence[str], files: int | None = None) -> None:
    """Declared columns in files that are each sorted by key and follow each other in key order.

    The number of files is that of the session's shuffle partitions, or ``files``.
    """
    rows = conform(df, schema)
    rows = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    rows.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)


def append_part(df: DataFrame, path: str, batch: int) -> None:
    df.withColumn("batch_id", F.lit(batch)).write.mode("append").parquet(path)


def next_batch(spark: SparkSession, path: str) -> int:
    from .files import exists

    if not exists(spark, path):
        return 0
    last = spark.read.parquet(path).agg(F.max("batch_id")).first()[0]
    return 0 if last is None else last + 1


#: The file that names the folder of a replaceable table's rows.
POINTER = "_CURRENT"


def _at(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in the file system that the path names, written anew."""
    at, fs = _at(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _rename(spark: SparkSession, old: str, new: str) -> None:
    """Put a file in the place of another in one step; raises where it fails."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    (a, fs), (b, _) = _at(spark, old), _at(spark, new)
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(a, b, options)


def _current(spark: SparkSession, path: str) -> str | None:
    note, fs = _at(spark, f"{path}/{POINTER}")
    if not fs.exists(note):
        return None
    jvm = spark.sparkContext._jvm
    lines = jvm.java.util.Scanner(fs.open(note), "UTF-8")
    try:
        return lines.nextLine()
    finally:
        lines.close()


def replace_table(df: DataFrame, path: str) -> None:
    """Write a new version of a table beside the old one, then point to it by one atomic rename.

    Readers (:func:`read_table`) see the old rows or the new; a failure before
    the rename leaves the old ones. The version before goes afterwards.
    """
    spark = df.sparkSession
    before, new = _current(spark, path), uuid.uuid4().hex
    df.write.parquet(f"{path}/{new}")
    put_text(spark, f"{path}/_{new}", new)
    _rename(spark, f"{path}/_{new}", f"{path}/{POINTER}")
    if before:
        old, fs = _at(spark, f"{path}/{before}")
        if not fs.delete(old, True):
            raise OSError(f"cannot delete the version before: {old}")


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table from :func:`replace_table`; None where there is none."""
    version = _current(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/{version}")


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """CSV files with a header each; ``files`` bounds their number for small reports."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, files: int | None = None) -> None:
    rows = df.select(F.to_json(F.struct("*")).alias("value"))
    (rows.coalesce(files) if files else rows).write.mode("overwrite").text(path)


def write_summary(row: DataFrame, path: str) -> None:
    """The one row of a summary as ``name: value`` lines."""
    put_text(row.sparkSession, path, "".join(f"{k}: {v}\n" for k, v in row.first().asDict().items()))


def dump_registry(path: str, global_ids: DataFrame, targets: DataFrame, offsets: DataFrame, source_to_target: DataFrame, concepts: DataFrame) -> None:
    """A registry as five folders of JSON lines (key, value) and the two numbers of its size.

    Keys and values are text: global id to "source:label", target id to its name,
    source to its offset, global id to target id, and channel to concept.
    """
    text = lambda c: F.col(c).cast("string")
    parts = {
        "global_id2source": global_ids.select(text("global_id").alias("key"), F.concat_ws(":", "source", "label").alias("value")),
        "target_id2label": targets.select(text("target_id").alias("key"), text("target").alias("value")),
        "dataset_offsets": offsets.select(text("source").alias("key"), text("offset").alias("value")),
        "source_to_target": source_to_target.select(text("global_id").alias("key"), text("target_id").alias("value")),
        "concept_id2name": concepts.select(text("position").alias("key"), text("name").alias("value")),
    }
    for name, df in parts.items():
        write_json(df, f"{path}/{name}")
    sizes = targets.agg(F.count(F.lit(1)).alias("num_target_classes")).join(global_ids.agg(F.count(F.lit(1)).alias("num_global_source_classes")))
    write_json(sizes, f"{path}/params", 1)


def resolve_input(explicit: str | None, variable: str, template: str, legacy: str) -> str:
    """The given path, else the template at the environment's version, else the legacy path."""
    version = os.environ.get(variable)
    return explicit or (template.format(version) if version else legacy)


def version_tag(explicit: str | None = None, variable: str = "DATASET_VERSION", today: dt.date | None = None) -> str:
    """The given tag, else the environment's, else date and commit, else date and nogit."""
    if explicit or os.environ.get(variable):
        return explicit or os.environ[variable]
    day = (today or dt.date.today()).strftime("%Y%m%d")
    try:
        sha = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        sha = "nogit"
    return f"{day}_{sha}"


def checkpoint_paths(pull: str | None, push: str | None) -> tuple[str | None, str | None]:
    """Where to read and write a checkpoint; reading falls back to the place of writing."""
    return pull or push, push
