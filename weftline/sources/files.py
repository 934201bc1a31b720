"""Readers of source folders, listings, label files and restartable part files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.schemas import empty

CSV_FILES = ("annotations.csv", "image_list.csv", "labelset.csv", "metadata.csv")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or a glob of paths matches something, in any file system of Hadoop."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame | None:
    """A CSV with a header, all columns as text; None where the path is missing.

    Short rows are padded with nulls, quoted commas kept. ``columns`` fixes the
    columns of many files with one header; else the header is read.
    """
    if not exists(spark, path):
        return None
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    reader = reader.option("ignoreLeadingWhiteSpace", True)
    if columns:
        return reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)
    return reader.csv(path)


def source_id_of(path: Column) -> Column:
    return F.regexp_extract(path, r"/s(\d+)/", 1).try_cast("int")


def read_source_csvs(spark: SparkSession, root: str, name: str, columns: Sequence[str]) -> DataFrame:
    """One file of every source folder under ``root`` with its source_id; no rows where none exists."""
    found = read_text_csv(spark, f"{root}/s*/{name}", columns)
    if found is None:
        return empty(spark, T.StructType([T.StructField("source_id", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in columns]]))
    return found.withColumn("source_id", source_id_of(F.col("_metadata.file_path"))).where("source_id is not null").select("source_id", *columns)


def unreadable(spark: SparkSession, root: str, names: Sequence[str] = CSV_FILES) -> DataFrame:
    """(source_id, file, error) of source files that have bytes but give no line, so one broken file fails no other."""
    rows = []
    for name in names:
        glob = f"{root}/s*/{name}"
        if exists(spark, glob):
            listed = list_objects(spark, glob).where("length > 0").select(source_id_of(F.col("path")).alias("source_id"))
            read = spark.read.option("ignoreCorruptFiles", True).text(glob).select(source_id_of(F.col("_metadata.file_path")).alias("source_id"))
            rows.append(listed.join(read.distinct(), "source_id", "left_anti").select("source_id", F.lit(name).alias("file"), F.lit("unreadable").alias("error")))
    out = spark.createDataFrame([], "source_id int, file string, error string")
    for df in rows:
        out = out.unionByName(df)
    return out


def list_objects(spark: SparkSession, glob: str, root: str | None = None) -> DataFrame:
    """Paths and sizes of the files that match, without reading them."""
    if not exists(spark, glob):
        return spark.createDataFrame([], "path string, length bigint")
    return spark.read.format("binaryFile").load(glob).select("path", "length")


def list_sources(spark: SparkSession, root: str) -> DataFrame:
    """source_id and files of each ``s<digits>`` folder under ``root``, ascending by id."""
    found = list_objects(spark, f"{root}/s*/*").where(F.col("path").rlike(r"/s\d+/[^/]+$"))
    images = list_objects(spark, f"{root}/s*/images/*").where(F.col("path").rlike(r"/s\d+/images/[^/]+$"))
    both = found.unionByName(images).withColumn("source_id", source_id_of(F.col("path")))
    file = F.when(~F.col("path").contains("/images/"), F.substring_index("path", "/", -1))
    return both.groupBy("source_id").agg(F.array_sort(F.collect_set(file)).alias("files")).orderBy("source_id")


def sources_with(sources: DataFrame, files: Sequence[str] = ("annotations.csv", "image_list.csv")) -> DataFrame:
    """Sources that have all of the files."""
    return sources.where(F.array_size(F.array_intersect("files", F.array(*map(F.lit, files)))) == len(files)).select("source_id")


def image_objects(spark: SparkSession, root: str) -> DataFrame:
    rows = list_objects(spark, f"{root}/s*/images/*")
    return rows.select(source_id_of(F.col("path")).alias("source_id"), "path", "length").where("source_id is not null")


def resized_listing(paths: DataFrame, path: str = "path") -> DataFrame:
    """Listed resized images as completed checkpoint rows."""
    pattern = r"/resized/s(\d+)/images/(.+)\.jpg$"
    rows = paths.where(F.col(path).rlike(pattern))
    return rows.select(
        F.regexp_extract(path, pattern, 1).cast("int").alias("source_id"), F.regexp_extract(path, pattern, 2).alias("image_id"), F.lit("completed").alias("status")
    )


def read_point_text(spark: SparkSession, path: str) -> DataFrame:
    """``row;col;label`` lines; comments and malformed lines drop out, as do points labelled off."""
    parts = F.split("value", ";")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(parts) == 3))
    cell = lambda i: F.trim(F.element_at(parts, i))
    out = rows.select(cell(1).try_cast("int").alias("row"), cell(2).try_cast("int").alias("col"), cell(3).alias("label"))
    return out.dropna().where(F.lower("label") != "off")


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of text values as (label, target)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("label", "target"))


def read_literal_map(spark: SparkSession, path: str) -> DataFrame:
    """A file that assigns a dictionary of numbers to names in Python notation, as (id, name)."""
    body = F.regexp_extract(F.col("value"), r"(?s)(\{.*\})", 1)
    quoted = F.regexp_replace(F.translate(body, "'", '"'), r"(\d+)\s*:", '"$1":')
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(quoted, "map<string,string>")).alias("id", "name"))
    return whole.select(F.col("id").cast("int").alias("id"), "name")


def first_filled(*names: str) -> Column:
    """The first column that is not blank, for files that name a column differently."""
    return F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names])


def read_parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All readable part files of a restartable job; unreadable ones are skipped, none gives no rows."""
    if not exists(spark, f"{path}/*.parquet"):
        return empty(spark, schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(path)


def id_list(spark: SparkSession, text: str | None = None, path: str | None = None, column: str = "source_id") -> DataFrame:
    """Source ids from a comma list, a CSV or a Parquet file; exactly one of text and path."""
    if (text is None) == (path is None):
        raise ValueError("give either a list or a path")
    if text is not None:
        rows = spark.range(1).select(F.explode(F.split(F.lit(text), ",")).alias(column))
    else:
        rows = spark.read.parquet(path) if path.endswith(".parquet") else read_text_csv(spark, path)
    return rows.select(F.trim(F.col(column).cast("string")).try_cast("int").alias("source_id")).dropna().distinct().orderBy("source_id")


def non_blank_rows(spark: SparkSession, path: str) -> int | None:
    """Lines that are not blank, less the header; None for a missing file."""
    if not exists(spark, path):
        return None
    return max(0, spark.read.text(path).where(F.trim("value") != "").count() - 1)


def read_split(spark: SparkSession, path: str, splits: Sequence[str], column: str = "split") -> DataFrame:
    """Rows of the named splits; an unknown name is an error."""
    rows = spark.read.parquet(path)
    known = {r[0] for r in rows.select(column).distinct().collect()}
    if unknown := [s for s in splits if s not in known]:
        raise ValueError(f"unknown splits: {unknown}")
    return rows.where(F.col(column).isin(*splits))
