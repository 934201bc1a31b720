"""Dataset statistics: counts per class, source and split, quantiles, shares and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import label_kind, percent


def class_counts(points: DataFrame, classes: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Per class: its kind, and annotations, images and the share of the split, for every split.

    ``points`` has split, target_id and image_id; ``classes`` has target_id and
    target_name, and every class of it has a row. A split without points has
    shares of 0.
    """
    counted = points.groupBy("split", "target_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("image_id").alias("images")
    )
    total = F.sum("n").over(Window.partitionBy("split"))
    counted = counted.withColumn("share", F.col("n") / total)
    wide = counted.groupBy("target_id").agg(
        *[
            F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{name}")
            for s in splits
            for c, name in (("n", "annotations"), ("images", "images"), ("share", "fraction"))
        ]
    )
    zeros = {f"{s}_{n}": 0 for s in splits for n in ("annotations", "images")} | {f"{s}_fraction": 0.0 for s in splits}
    named = classes.select("target_id", "target_name", label_kind(F.col("target_id"), F.col("target_name")).alias("class_kind"))
    return named.join(wide, "target_id", "left").fillna(zeros)


def source_of(rows: DataFrame) -> list[Column]:
    """source_type and source_key of rows: a region by its name where there are regions, else a source by its id."""
    kind, key = ("region", "region_name") if "region_id" in rows.columns else ("source", "source_id")
    return [F.lit(kind).alias("source_type"), F.col(key).cast("string").alias("source_key")]


def class_by_source(points: DataFrame, classes: DataFrame) -> DataFrame:
    """Annotations and images per source, class and split; background and unknown classes drop out."""
    named = points.where("target_id != 0").join(classes.select("target_id", "target_name"), "target_id")
    keys = [*source_of(points), "target_id", "target_name", "split"]
    return named.groupBy(*keys).agg(F.count(F.lit(1)).alias("annotations"), F.count_distinct("image_id").alias("images"))


def source_stats(images: DataFrame, points: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Images and annotations per source and split, 0 where there are none; keys as text."""
    per = lambda df, name: df.groupBy(*source_of(df)).agg(*[F.count_if(F.col("split") == s).alias(f"{s}_{name}") for s in splits])
    return per(images, "images").join(per(points, "annotations"), ["source_type", "source_key"], "full").fillna(0)


def per_image_summary(images: DataFrame, points: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Totals, and the distribution of annotations per image with empty images in it."""
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    every = images.select(*keys).distinct().join(counts, list(keys), "left").select(n.alias("n"))
    q = lambda p: F.percentile("n", F.lit(p))
    return every.agg(
        F.count(F.lit(1)).alias("n_images"), F.sum("n").alias("n_annotations"), F.avg("n").alias("mean"),
        q(0.5).alias("median"), q(0.1).alias("p10"), q(0.9).alias("p90"), F.min("n").alias("min"), F.max("n").alias("max"),
    )


def top_shares(points: DataFrame, key: str, tops: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Shares of the largest groups, and the effective number of groups exp(-sum p ln p); all 0.0 without rows."""
    counts = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # one row per class: a window over all of them is small
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.col(key))))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return ranked.withColumn("p", p).agg(
        *[F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("p"))), F.lit(0.0)).alias(f"top{k}_share") for k in tops],
        F.coalesce(F.exp(-F.sum(F.col("p") * F.log("p"))), F.lit(0.0)).alias("effective_classes"),
    )


def value_counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(key))


def labels_per_image(points: DataFrame, label: Column, keys: Sequence[str]) -> DataFrame:
    """Distinct labels of each image, sorted and joined by commas."""
    return points.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"))


def dimension_spread(images: DataFrame, key: str) -> DataFrame:
    """Mean, sample deviation, variation in percent, aspect and range of image widths per group."""
    w, h = F.col("width"), F.col("height")
    return images.groupBy(key).agg(
        F.avg(w).alias("mean_width"), F.stddev_samp(w).alias("std_width"),
        (100 * F.stddev_samp(w) / F.avg(w)).alias("cv_width"), F.avg(w / F.nullif(h, F.lit(0))).alias("mean_aspect"),
        F.min(w).alias("min_width"), F.max(w).alias("max_width"),
    )


def flag_report(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """How many rows hold each condition, and the percentage; one pass over the rows."""
    names = list(flags)
    one = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(f) for f, c in flags.items()])
    return one.unpivot(["_n"], names, "metric", "n").select("metric", "n", percent(F.col("n"), F.col("_n")).alias("pct"))


def totals(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums as rows of metric and value."""
    one = rows.agg(*[F.sum(c).cast("bigint").alias(c) for c in columns])
    return one.unpivot([], list(columns), "metric", "value")


def run_comparison(rows: DataFrame, run: str, keys: Sequence[str], status: str, statuses: Sequence[str], nulls: Sequence[str]) -> DataFrame:
    """Per run: rows, distinct sources, distinct keys, rows of each status and nulls of columns."""
    return rows.groupBy(run).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(keys[0]).alias("sources"),
        F.count_distinct(F.struct(*keys)).alias("distinct_keys"),
        *[F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses],
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in nulls],
    )


def with_total(rows: DataFrame, key: str, aggregates: Sequence[Column], total: str = "TOTAL") -> DataFrame:
    """Groups and a total row, distinct counts of which are counted anew."""
    out = rows.rollup(key).agg(F.grouping(key).alias("_all"), *aggregates)
    return out.withColumn(key, F.when(F.col("_all") == 1, total).otherwise(F.col(key))).drop("_all")


def pivot_with_total(rows: DataFrame, key: str, column: str, values: Sequence[str], total: str = "TOTAL") -> DataFrame:
    """Counts of key by column, 0 for none, with a total row and column."""
    counts = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return with_total(rows, key, [*counts, F.count(F.lit(1)).alias(total)], total)


def distinct_over_columns(rows: DataFrame, key: str, columns: Sequence[str], images: Sequence[str]) -> DataFrame:
    """Distinct values over several columns and distinct images, per group and in all."""
    long = rows.unpivot([key, *images], list(columns), "annotator", "label")
    return with_total(
        long, key, [F.count_distinct("label").alias("n_labels"), F.count_distinct(F.struct(*images)).alias("n_images")]
    )


def label_stats(rows: DataFrame, label: str, keep_null: bool = True) -> DataFrame:
    """Rows, distinct images and distinct sources per label, with the null label or without."""
    rows = rows if keep_null else rows.where(F.col(label).isNotNull())
    return rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_annotations"), F.count_distinct("image_id").alias("n_images"), F.count_distinct("source_id").alias("n_sources"),
    )


def unmapped_share(counts: DataFrame, mapped: str, n: str) -> DataFrame:
    missing = F.coalesce(F.sum(F.when(F.col(mapped).isNull(), F.col(n))), F.lit(0))
    return counts.agg(missing.alias("unmapped"), F.sum(n).alias("total"), percent(missing, F.sum(n), 2).alias("pct"))


def concept_counts(counts: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per concept: the annotations of all classes that have it. ``counts`` has label and n, ``concepts`` label, concept and value (1: has it)."""
    return concepts.where("value = 1").join(counts.select("label", "n"), "label").groupBy("concept").agg(F.sum("n").alias("n"))


def failure_report(failures: DataFrame, points: DataFrame, label: Column) -> DataFrame:
    """Load failures with the number and labels of the annotations that their image had; a failure without any is told apart."""
    known = points.groupBy("image_id").agg(F.count(F.lit(1)).alias("annotation_count"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("annotation_labels"))
    out = failures.join(known, "image_id", "left").withColumn("missing_annotations", F.col("annotation_count").isNull())
    return out.withColumns({"annotation_count": F.coalesce("annotation_count", F.lit(0)), "annotation_labels": F.coalesce("annotation_labels", F.lit(""))})


def class_weights(rows: DataFrame, key: str, constant: float = 1.0) -> DataFrame:
    """1 / sqrt(n + constant), divided by their mean."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("w", 1 / F.sqrt(F.col("n") + constant))
    return counts.withColumn("weight", F.col("w") / F.avg("w").over(Window.partitionBy(F.lit(1)))).drop("w")


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins numbered from 1; below is 0, at or above the end is bins + 1."""
    return rows.groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_per_group(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    counts = rows.groupBy(group, key).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.col(key)))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def group_size_summary(rows: DataFrame, key: str) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("groups"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("max"))


def describe(rows: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, range and exact quartiles."""
    q = lambda p: F.percentile(column, F.lit(p))
    return rows.agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"),
        q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(column).alias("max"),
    )
