from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import remediate as R

from .base import Views, query

_FLAGS = {
    "has_images_folder": ("o_orderkey % 13", 0), "has_annotations_csv": ("o_orderkey % 17", 0), "has_image_list_csv": ("o_orderkey % 19", 0),
    "image_list_covers_annotations": ("o_orderkey % 5", 0), "image_count_match": ("o_orderkey % 2", 0),
}


def _report(v):
    k = F.col("o_orderkey")
    probes = v.orders.select(
        k.alias("source_id"), (k % 7 != 0).alias("accessible"), F.when(k % 3 != 0, k % 11).alias("n_confirmed_website"), (k % 9).alias("total_images_website"),
    )
    audit = v.orders.where(k % 23 != 0).select(
        k.alias("source_id"), *[F.expr(f"{e} != {n}").alias(c) for c, (e, n) in _FLAGS.items()],
        (k % 29 == 0).alias("annotations_csv_read_failed"), F.when(k % 4 != 0, k % 31 == 0).alias("annotations_empty"),
        F.when(k % 37 != 0, k % 6).alias("n_images_s3"), (k % 10).alias("n_annotations"),
    )
    return R.probe_report(probes, audit, "n_annotations")


_REPORT = """r AS (SELECT o_orderkey AS source_id, o_orderkey AS k, o_orderkey % 7 <> 0 AS accessible, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 11 END AS conf,
o_orderkey % 9 AS tw, CASE WHEN o_orderkey % 37 <> 0 THEN o_orderkey % 6 ELSE 0 END AS s3 FROM orders),
rep AS (SELECT source_id, CASE WHEN accessible THEN tw - CASE WHEN k % 23 <> 0 THEN s3 ELSE 0 END END AS images_gap, CASE WHEN k % 23 = 0 THEN 'manual_review' WHEN NOT accessible THEN 'skip_not_accessible' WHEN conf = 0 THEN 'skip_no_confirmed_annotations'
WHEN tw = 0 THEN 'skip_empty_website' WHEN tw < s3 THEN 'manual_review' WHEN k % 13 = 0 OR k % 17 = 0 OR k % 19 = 0 THEN 'full_redownload'
WHEN k % 29 = 0 OR (k % 4 <> 0 AND k % 31 = 0) OR k % 10 = 0 OR k % 5 = 0 THEN 'redownload_csv' WHEN k % 2 = 0 AND tw > s3 THEN 'redownload_images' ELSE 'manual_review' END AS action FROM r)"""


@query(f"WITH {_REPORT} SELECT * FROM rep")
def remediation_actions(spark, sf_dir):
    return _report(Views(spark, sf_dir)).select("source_id", "images_gap", "action")


@query(f"""WITH {_REPORT} SELECT source_id, action, action = 'full_redownload' AS download_metadata, action = 'full_redownload' AS download_labelset,
action <> 'redownload_images' AS download_annotations, action <> 'redownload_csv' AS download_images FROM rep WHERE action IN ('full_redownload', 'redownload_csv', 'redownload_images')""")
def action_flags(spark, sf_dir):
    out = R.download_flags(R.redownload_queue(_report(Views(spark, sf_dir))))
    return out.select("source_id", "action", "download_metadata", "download_labelset", "download_annotations", "download_images")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 50 < o_orderkey % 30 THEN 'fewer rows than before' WHEN o_orderkey % 60 > 0 AND o_orderkey % 50 < 0.9 * (o_orderkey % 60) THEN 'too few of the stored images' END AS reason FROM orders""")
def coverage_guard(spark, sf_dir):
    k = F.col("o_orderkey")
    return Views(spark, sf_dir).orders.select("o_orderkey", R.coverage_guard(k % 50, k % 30, k % 60).alias("reason"))


@query("SELECT o_orderkey, NOT (o_orderkey % 5 = 0) AND (o_orderstatus = 'F' OR o_orderkey % 3 = 0) AS skip FROM orders")
def skip_decision(spark, sf_dir):
    k = F.col("o_orderkey")
    return Views(spark, sf_dir).orders.select("o_orderkey", R.skip_download(k % 5 == 0, F.col("o_orderstatus") == "F", k % 3 == 0).alias("skip"))


@query("SELECT o_orderkey, cast(least(1800, greatest(180, 120 + o_orderkey // 20)) AS INTEGER) AS prep, cast(least(900, greatest(120, 60 + o_orderkey // 50)) AS INTEGER) AS serve FROM orders")
def timeouts(spark, sf_dir):
    k = F.col("o_orderkey")
    return Views(spark, sf_dir).orders.select("o_orderkey", R.timeout_seconds(k, 180, 1800, 120, 20).alias("prep"), R.timeout_seconds(k, 120, 900, 60, 50).alias("serve"))
