"""What to do about incomplete sources: decisions as ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIP_NOT_ACCESSIBLE = "skip_not_accessible"
SKIP_NO_CONFIRMED = "skip_no_confirmed_annotations"
SKIP_EMPTY = "skip_empty_website"
MANUAL = "manual_review"
FULL, CSV, IMAGES = "full_redownload", "redownload_csv", "redownload_images"
REDOWNLOADS = (FULL, CSV, IMAGES)

#: What an action downloads: metadata, labelset, annotations, images.
DOWNLOADS = {FULL: (True, True, True, True), CSV: (False, False, True, False), IMAGES: (False, False, False, True)}


def action() -> Column:
    """The action for a probe row joined to its audit row; null flags are false, null counts 0.

    Conditions are tried in order: a closed source, one without confirmed
    points or images; fewer images on the site than stored; a missing part; a
    broken or empty annotation file; an image list that does not cover; missing
    images. Anything else needs a person.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    on_site, stored = count("total_images_website"), count("n_images_s3")
    parts = flag("has_images_folder") & flag("has_annotations_csv") & flag("has_image_list_csv")
    broken = flag("annotations_csv_read_failed") | flag("annotations_empty") | (count("n_annotations") == 0)
    return (
        F.when(~flag("accessible"), SKIP_NOT_ACCESSIBLE)
        .when(F.col("n_confirmed_website") == 0, SKIP_NO_CONFIRMED)
        .when(on_site == 0, SKIP_EMPTY)
        .when(on_site < stored, MANUAL)
        .when(~parts, FULL)
        .when(broken | ~flag("image_list_covers_annotations"), CSV)
        .when(~flag("image_count_match") & (on_site > stored), IMAGES)
        .otherwise(MANUAL)
    )


def probe_report(probes: DataFrame, audit: DataFrame, position: str = "source_id") -> DataFrame:
    """Probes with their audit row (the first, if several), the image gap and the action."""
    first = audit.groupBy("source_id").agg(F.min_by(F.struct(*[c for c in audit.columns if c != "source_id"]), position).alias("_audit"))
    rows = probes.join(first, "source_id", "left").select(*[F.col(c) for c in probes.columns], "_audit.*", F.col("_audit").isNotNull().alias("_known"))
    gap = F.when(F.col("accessible"), F.col("total_images_website") - F.coalesce("n_images_s3", F.lit(0)))
    return rows.withColumn("images_gap", gap).withColumn("action", F.when(F.col("_known"), action()).otherwise(MANUAL)).drop("_known")


def redownload_queue(report: DataFrame) -> DataFrame:
    return report.where(F.col("action").isin(*REDOWNLOADS)).orderBy("source_id")


def download_flags(report: DataFrame) -> DataFrame:
    """Redownload actions with what each of them fetches."""
    rows = [(a, *flags) for a, flags in DOWNLOADS.items()]
    dim = report.sparkSession.createDataFrame(
        rows, "action string, download_metadata boolean, download_labelset boolean, download_annotations boolean, download_images boolean"
    )
    return report.join(F.broadcast(dim), "action")


def coverage_guard(new: Column, existing: Column, stored: Column, least: float = 0.9) -> Column:
    """Why a new image list is refused, or null: shorter than the old one, or than most stored images."""
    return F.when(new < existing, "fewer rows than before").when((stored > 0) & (new < least * stored), "too few of the stored images")


def skip_download(force: Column, complete: Column, present: Column) -> Column:
    return ~force & (complete | present)


def timeout_seconds(images: Column, least: int, most: int, base: int, per: int) -> Column:
    """base + images // per, kept within least and most; least for none or unknown."""
    n = F.coalesce(images, F.lit(0))
    return F.when(n <= 0, least).otherwise(F.least(F.lit(most), F.greatest(F.lit(least), F.lit(base) + F.floor(n / per)))).cast("int")
