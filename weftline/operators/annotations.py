"""Annotation merge and source audit over per-source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import coerced_int, name_without_status, null_if_empty, percent, status_in_name, url_image_id
from weftline.schemas import AUDIT, conform

def merge_annotations(points: DataFrame, image_list: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """Confirmed points of all sources with their provider image id.

    ``points`` has source_id, Name, Row, Column, "Label ID" and maybe Status, all
    text; ``image_list`` has source_id, Name and "Image Page". A name in the image
    list may end in the status of its image: points find it by the name
    without that, and take that status where no Status of their own says more.
    An image listed twice doubles its points. With ``audit``, incomplete sources drop out.
    """
    own = F.col("Status") if "Status" in points.columns else F.lit(None).cast("string")
    rows = points.select(
        "source_id", "Name", coerced_int(F.col("Row")).alias("row"), coerced_int(F.col("Column")).alias("col"),
        coerced_int(F.col("`Label ID`")).alias("label_id"), own.alias("own"),
    )
    if audit is not None:
        rows = rows.join(audit.where("is_complete").select("source_id"), "source_id", "left_semi")
    # what no image can confirm goes before the join
    rows = rows.where("own is null or own = 'Confirmed'").dropna(subset=["row", "col", "label_id"])
    pages = image_list.select(
        "source_id", name_without_status(F.col("Name")).alias("Name"), status_in_name(F.col("Name")).alias("image_status"),
        url_image_id(F.col("`Image Page`")).alias("image_id"),
    )
    joined = rows.join(pages.where("image_id is not null"), ["source_id", "Name"]).withColumn("status", F.coalesce("own", "image_status"))
    return joined.where("status = 'Confirmed'").select("source_id", "image_id", "row", "col", "label_id", "status")


def is_complete(c: str = "") -> Column:
    """Folder, both CSVs, some annotations, and an image list that covers them."""
    f = lambda n: F.col(c + n)
    return f("has_images_folder") & f("has_annotations_csv") & f("has_image_list_csv") & (f("n_annotations") > 0) & f("image_list_covers_annotations")


#: The four files of a source, and the column that counts the rows of each.
FILES = {"annotations.csv": "n_annotations", "image_list.csv": "n_images_csv", "labelset.csv": "n_labels", "metadata.csv": "n_metadata_rows"}


def source_audit(
    sources: DataFrame, objects: DataFrame, annotations: DataFrame, image_list: DataFrame, labelset: DataFrame, metadata: DataFrame,
    failures: DataFrame | None = None, at: Column | None = None,
) -> DataFrame:
    """One row per source from its listed objects and the rows of its files, with all columns of the schema ``AUDIT``.

    ``sources`` lists the files that are there in an array ``files``; ``failures``
    (source_id, file, error) names those that could not be read, which count as
    there, without rows. Counts of a missing optional file are null, others 0.
    Annotated images are distinct over the first of Name, image and image_id;
    the image list counts by rows. ``at`` is the time of the audit.
    """
    name = F.col(next(c for c in ("Name", "image", "image_id") if c in annotations.columns))
    tables = dict(zip(FILES, (annotations, image_list, labelset, metadata), strict=True))
    out = sources.join(objects.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_images_s3")), "source_id", "left")
    for file, df in tables.items():
        aggs = [F.count(F.lit(1)).alias(FILES[file])]
        if file == "annotations.csv":
            aggs.append(F.count_distinct(name).alias("n_unique_images_annotated"))
        out = out.join(df.groupBy("source_id").agg(*aggs), "source_id", "left")
    if failures is None:
        failures = sources.sparkSession.createDataFrame([], "source_id int, file string, error string")
    told = F.struct("file", F.concat("file", F.lit(" read failed: "), "error").alias("text"))
    broken = failures.groupBy("source_id").agg(F.collect_set("file").alias("failed"), F.array_sort(F.collect_set(told)).alias("told"))
    out = out.join(broken, "source_id", "left").withColumn("failed", F.coalesce("failed", F.array().cast("array<string>")))
    columns, stem = {}, lambda file: file.removesuffix(".csv")
    for file, count in FILES.items():
        failed = F.array_contains("failed", file)
        has = F.array_contains("files", file) | failed
        read = F.when(has & ~failed, F.coalesce(count, F.lit(0)))
        columns |= {f"has_{stem(file)}_csv": has, f"{stem(file)}_csv_read_failed": failed}
        columns[count] = read if file in ("labelset.csv", "metadata.csv") else F.coalesce(read, F.lit(0))
        columns[f"{stem(file)}_empty"] = F.coalesce(read == 0, F.lit(False))
    out = out.withColumns(
        columns
        | {
            "n_images_s3": F.coalesce("n_images_s3", F.lit(0)),
            "n_unique_images_annotated": F.when(F.array_contains("failed", "annotations.csv"), 0).otherwise(F.coalesce("n_unique_images_annotated", F.lit(0))),
            "errors": null_if_empty(F.transform("told", lambda t: t["text"])),
            "audit_timestamp": F.current_timestamp() if at is None else at,
        }
    )
    out = out.withColumns(
        {
            "has_images_folder": F.col("n_images_s3") > 0,
            "image_count_match": F.col("n_images_s3") == F.col("n_images_csv"),
            "image_list_covers_annotations": F.col("n_images_csv") >= F.col("n_unique_images_annotated"),
        }
    )
    return conform(out.withColumn("is_complete", is_complete()), AUDIT)


def audit_totals(audit: DataFrame) -> DataFrame:
    done = F.count_if("is_complete")
    return audit.agg(
        F.count(F.lit(1)).alias("n_sources"), done.alias("n_complete"), percent(done, F.count(F.lit(1))).alias("pct_complete"),
        F.sum("n_images_s3").alias("n_images"), F.sum("n_annotations").alias("n_annotations"),
    )

