from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import annotations as A
from weftline.operators import remediate as P
from weftline.operators import workqueue as Q
from weftline.operators.manifest import latest_rows

from .base import ANN, IMG, LATEST, RUNS, Views, query


_AT = "2026-01-02 03:04:05"


def _audit(v):
    """Sources are nations: objects are orders by customer nation, points are line items by supplier nation."""
    k = F.col("n_nationkey")
    nation = v.nation.select(
        k.cast("int").alias("source_id"),
        F.filter(
            F.array(
                F.when(k != 23, "annotations.csv"), F.when(k % 6 != 0, "image_list.csv"), F.when(k % 3 == 0, "labelset.csv"), F.when(k % 4 == 0, "metadata.csv"),
            ),
            lambda f: f.isNotNull(),
        ).alias("files"),
    )
    bad = v.nation.where("n_nationkey IN (7, 9)").select(
        k.cast("int").alias("source_id"), F.when(k == 7, "annotations.csv").otherwise("labelset.csv").alias("file"), F.concat(F.lit("bad bytes in "), "n_name").alias("error")
    )
    cust = v.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("source_id"))
    objects = v.orders.select("o_custkey", "o_orderkey").join(cust, "o_custkey")
    supplier = v.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias("source_id"))
    points = v.lineitem.select("l_orderkey", "l_suppkey").join(supplier, "l_suppkey").where("source_id != 22")
    points = points.select("source_id", (F.col("l_orderkey") % (10 + 30 * F.col("source_id"))).cast("string").alias("Name"))
    images = objects.where("o_orderkey % 5 != 0 or source_id % 2 = 0").select("source_id", (F.col("o_orderkey") % 7).cast("string").alias("Name"))
    labels = supplier.select("source_id")
    return A.source_audit(nation, objects, points, images, labels, labels.where("source_id != 8"), bad, F.lit(_AT).cast("timestamp"))


_AUDIT = f"""o AS (SELECT c_nationkey AS k, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT s_nationkey AS k, l_orderkey % (10 + 30 * s_nationkey) AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> 22),
f AS (SELECT cast(n_nationkey AS INTEGER) AS source_id, n_nationkey AS k, n_name, coalesce(n3, 0) AS n_images_s3, n_nationkey <> 23 AS has_annotations_csv, n_nationkey % 6 <> 0 AS has_image_list_csv,
    n_nationkey % 3 = 0 AS has_labelset_csv, n_nationkey % 4 = 0 AS has_metadata_csv, n_nationkey = 7 AS annotations_csv_read_failed, n_nationkey = 9 AS labelset_csv_read_failed,
    coalesce(na, 0) AS na, coalesce(nu, 0) AS nu, coalesce(ni, 0) AS ni, coalesce(ns, 0) AS ns FROM nation
  LEFT JOIN (SELECT k, count(*) AS n3, count(*) FILTER (WHERE o_orderkey % 5 <> 0 OR k % 2 = 0) AS ni FROM o GROUP BY 1) x ON x.k = n_nationkey
  LEFT JOIN (SELECT k, count(*) AS na, count(DISTINCT name) AS nu FROM a GROUP BY 1) y ON y.k = n_nationkey
  LEFT JOIN (SELECT s_nationkey AS k, count(*) AS ns FROM supplier GROUP BY 1) z ON z.k = n_nationkey),
g AS (SELECT source_id, '{_AT}' AS audit_timestamp, n_images_s3 > 0 AS has_images_folder, has_annotations_csv, has_image_list_csv, has_labelset_csv, has_metadata_csv, n_images_s3,
    CASE WHEN has_image_list_csv THEN ni ELSE 0 END AS n_images_csv, CASE WHEN has_annotations_csv AND NOT annotations_csv_read_failed THEN na ELSE 0 END AS n_annotations,
    CASE WHEN annotations_csv_read_failed THEN 0 ELSE nu END AS n_unique_images_annotated, CASE WHEN has_labelset_csv AND NOT labelset_csv_read_failed THEN ns END AS n_labels,
    CASE WHEN has_metadata_csv THEN CASE WHEN k = 8 THEN 0 ELSE ns END END AS n_metadata_rows, has_annotations_csv AND NOT annotations_csv_read_failed AND na = 0 AS annotations_empty,
    has_image_list_csv AND ni = 0 AS image_list_empty, has_labelset_csv AND NOT labelset_csv_read_failed AND ns = 0 AS labelset_empty, has_metadata_csv AND (k = 8 OR ns = 0) AS metadata_empty,
    annotations_csv_read_failed, false AS image_list_csv_read_failed, labelset_csv_read_failed, false AS metadata_csv_read_failed,
    CASE k WHEN 7 THEN 'annotations.csv read failed: bad bytes in ' || n_name WHEN 9 THEN 'labelset.csv read failed: bad bytes in ' || n_name END AS errors FROM f),
audit AS (SELECT *, n_images_s3 = n_images_csv AS image_count_match, n_images_csv >= n_unique_images_annotated AS image_list_covers_annotations,
    has_images_folder AND has_annotations_csv AND has_image_list_csv AND n_annotations > 0 AND n_images_csv >= n_unique_images_annotated AS is_complete FROM g)"""


@query(f"WITH {_AUDIT} SELECT * FROM audit")
def source_audit(spark, sf_dir):
    out = _audit(Views(spark, sf_dir))
    return out.withColumns({"audit_timestamp": F.date_format("audit_timestamp", "yyyy-MM-dd HH:mm:ss"), "errors": F.array_join("errors", "; ")})


@query(f"""WITH {_AUDIT} SELECT count(*) AS n_sources, count(*) FILTER (WHERE is_complete) AS n_complete,
round(100.0 * count(*) FILTER (WHERE is_complete) / count(*), 1) AS pct_complete, cast(sum(n_images_s3) AS BIGINT) AS n_images, cast(sum(n_annotations) AS BIGINT) AS n_annotations FROM audit""")
def audit_totals(spark, sf_dir):
    return A.audit_totals(_audit(Views(spark, sf_dir)))


@query(f"WITH {_AUDIT} SELECT source_id FROM audit WHERE is_complete")
def complete_sources(spark, sf_dir):
    return _audit(Views(spark, sf_dir)).where("is_complete").select("source_id")


@query(f"""WITH {_AUDIT}, p AS (SELECT cast(n_nationkey AS INTEGER) AS source_id, n_nationkey <> 3 AS accessible, n_nationkey % 11 AS n_confirmed_website, 50 * (n_nationkey % 15) AS tw FROM nation UNION ALL VALUES (99, true, 5, 10))
SELECT source_id, accessible, CASE WHEN accessible THEN cast(tw - coalesce(n_images_s3, 0) AS BIGINT) END AS images_gap, coalesce(is_complete, false) AS is_complete,
CASE WHEN audit.source_id IS NULL THEN 'manual_review' WHEN NOT accessible THEN 'skip_not_accessible' WHEN n_confirmed_website = 0 THEN 'skip_no_confirmed_annotations' WHEN tw = 0 THEN 'skip_empty_website'
  WHEN tw < n_images_s3 THEN 'manual_review' WHEN NOT (has_images_folder AND has_annotations_csv AND has_image_list_csv) THEN 'full_redownload'
  WHEN annotations_csv_read_failed OR annotations_empty OR n_annotations = 0 OR NOT image_list_covers_annotations THEN 'redownload_csv'
  WHEN NOT image_count_match AND tw > n_images_s3 THEN 'redownload_images' ELSE 'manual_review' END AS action FROM p LEFT JOIN audit USING (source_id)""")
def audit_probe_report(spark, sf_dir):
    v = Views(spark, sf_dir)
    k = F.col("n_nationkey")
    probes = v.nation.select(
        k.cast("int").alias("source_id"), (k != 3).alias("accessible"), (k % 11).cast("bigint").alias("n_confirmed_website"), (50 * (k % 15)).cast("bigint").alias("total_images_website")
    ).unionByName(spark.sql("SELECT 99 AS source_id, true AS accessible, 5L AS n_confirmed_website, 10L AS total_images_website"))
    report = P.probe_report(probes, _audit(v))
    return report.select("source_id", "accessible", "images_gap", F.coalesce("is_complete", F.lit(False)).alias("is_complete"), "action")


@query("""WITH p AS (SELECT cast(l_orderkey % 50 AS INTEGER) AS source_id, l_orderkey, CASE WHEN l_partkey % 3 = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'Confirmed' ELSE 'Unconfirmed' END END AS own,
    l_linenumber * 100 AS row, cast(trunc(l_quantity) AS INTEGER) * 10 AS col, cast(l_partkey % 40 AS INTEGER) AS label_id FROM lineitem WHERE l_partkey % 17 <> 0),
i AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Confirmed' WHEN 1 THEN 'Unconfirmed' WHEN 2 THEN 'Confirmed' END AS listed FROM orders WHERE o_orderkey % 11 <> 0),
twice AS (SELECT * FROM i UNION ALL SELECT * FROM i WHERE o_orderkey % 13 = 0)
SELECT source_id, cast(l_orderkey AS VARCHAR) AS image_id, row, col, label_id, coalesce(own, listed) AS status FROM p JOIN twice ON l_orderkey = o_orderkey WHERE coalesce(own, listed) = 'Confirmed'""")
def merge_annotations_confirmed(spark, sf_dir):
    """The image list's names end in a status (or none); some points have one of their own, and some images are listed twice."""
    v = Views(spark, sf_dir)
    points = v.lineitem.select(
        (F.col("l_orderkey") % 50).cast("int").alias("source_id"),
        F.concat(F.lit("img_"), F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("Name"),
        (F.col("l_linenumber") * 100).cast("string").alias("Row"),
        F.concat((F.col("l_quantity").cast("int") * 10).cast("string"), F.lit(".0")).alias("Column"),
        F.when(F.col("l_partkey") % 17 == 0, "n/a").otherwise((F.col("l_partkey") % 40).cast("string")).alias("Label ID"),
        F.when(F.col("l_partkey") % 3 == 0, F.when(F.col("l_linenumber") % 2 == 0, "Confirmed").otherwise("Unconfirmed")).alias("Status"),
    )
    n, k = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    suffix = F.when(n % 4 == 0, " - Confirmed").when(n % 4 == 1, " - Unconfirmed").when(n % 4 == 2, " - Confirmed").otherwise("")
    listed = v.orders.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(n % 13 == 0, 2).otherwise(1)))).select(
        (n % 50).cast("int").alias("source_id"), F.concat(F.lit("img_"), k, F.lit(".jpg"), suffix).alias("Name"),
        F.when(n % 11 == 0, "/nothing/").otherwise(F.concat(F.lit("/image/"), k, F.lit("/view/"))).alias("Image Page"),
    )
    return A.merge_annotations(points, listed)


@query(f"""WITH {ANN} SELECT DISTINCT source_id, image_id FROM ann""")
def unique_images(spark, sf_dir):
    return Views(spark, sf_dir).ann.select("source_id", "image_id").distinct()


@query(f"""WITH {IMG} SELECT source_id, image_id, width, height, 'data/resized/s' || source_id || '/images/' || image_id || '.jpg' AS resized_key
FROM img WHERE needs_resize AND NOT EXISTS (SELECT 1 FROM lineitem WHERE cast(l_orderkey AS VARCHAR) = image_id AND l_linenumber > 4)""")
def todo_antijoin(spark, sf_dir):
    v = Views(spark, sf_dir)
    key = F.concat(F.lit("data/resized/s"), (F.col("l_orderkey") % 50).cast("string"), F.lit("/images/"), F.col("l_orderkey").cast("string"), F.lit(".jpg"))
    return Q.todo_from_listing(v.img, v.lineitem.where("l_linenumber > 4").select(key.alias("key")))


@query(f"""WITH {IMG}, {RUNS}, {LATEST} SELECT source_id, image_id FROM img WHERE needs_resize AND (source_id, image_id) NOT IN
(SELECT (source_id, image_id) FROM latest WHERE status <> 'failed')""")
def unexplained_gap(spark, sf_dir):
    v = Views(spark, sf_dir)
    done = latest_rows(v.runs).where("status != 'failed'")
    return Q.unseen(v.img.where("needs_resize").select("source_id", "image_id"), done)


@query(f"""WITH {IMG}, {RUNS}, {LATEST} SELECT source_id, image_id, width, height FROM latest JOIN img USING (source_id, image_id) WHERE status = 'skipped'""")
def pending_join_guard(spark, sf_dir):
    v = Views(spark, sf_dir)
    checkpoint = latest_rows(v.runs).withColumn("status", F.when(F.col("status") == "skipped", "pending").otherwise(F.col("status")))
    return Q.resume(checkpoint, v.img.select("source_id", "image_id", "width", "height"))


@query(f"""WITH {RUNS} SELECT source_id, image_id, coalesce(b.status, a.status) AS status, coalesce(b.resize_timestamp, a.resize_timestamp) AS resize_timestamp
FROM (SELECT * FROM runs WHERE run = 0) a LEFT JOIN (SELECT * FROM runs WHERE run = 1) b USING (source_id, image_id)""")
def apply_results(spark, sf_dir):
    first, second = Views(spark, sf_dir).runs
    return Q.apply_results(first, second)


@query("""SELECT count(*) FILTER (WHERE event_type = 'purchase') AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed,
count(*) FILTER (WHERE event_type NOT IN ('purchase', 'error') AND user_id % 3 = 0) AS skipped_corrupted,
count(*) FILTER (WHERE event_type NOT IN ('purchase', 'error') AND user_id % 3 <> 0) AS skipped_other FROM events""")
def checkpoint_summary(spark, sf_dir):
    t = F.col("event_type")
    rows = Views(spark, sf_dir).events.select(
        F.when(t == "purchase", "completed").when(t == "error", "failed").otherwise("skipped").alias("status"),
        F.when(F.col("user_id") % 3 == 0, "corrupted_header").when(F.col("user_id") % 3 == 1, "too_small").alias("skip_reason"),
    )
    return Q.checkpoint_summary(rows)


@query(f"""WITH {ANN} SELECT * EXCLUDE (tenth) FROM ann WHERE source_id IN (SELECT cast(s_suppkey % 50 AS INTEGER) FROM supplier WHERE s_acctbal > 5000)""")
def semi_join_eligible(spark, sf_dir):
    v = Views(spark, sf_dir)
    ok = v.supplier.where("s_acctbal > 5000").select((F.col("s_suppkey") % 50).cast("int").alias("source_id"))
    return v.ann.drop("tenth").join(ok, "source_id", "left_semi")


@query("""SELECT k, a.n AS n_customers, round(a.bal, 6) AS customer_balance, b.n AS n_suppliers FROM
(SELECT c_nationkey AS k, count(*) AS n, avg(c_acctbal) AS bal FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey + 10 AS k, count(*) AS n FROM supplier GROUP BY 1) b USING (k)""")
def full_outer_compare(spark, sf_dir):
    """Two summaries whose keys overlap in part."""
    v = Views(spark, sf_dir)
    a = v.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_customers"), (F.round(F.avg("c_acctbal"), 6) + 0.0).alias("customer_balance"))
    b = v.supplier.groupBy((F.col("s_nationkey") + 10).alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return a.join(b, "k", "full")


@query("SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber < 3")
def whitelist(spark, sf_dir):
    return Views(spark, sf_dir).lineitem.select("l_returnflag", "l_linenumber").where(F.col("l_returnflag").isin("A", "R") & (F.col("l_linenumber") < 3))


@query("""SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality NOT IN (0), true)""")
def blacklist_null_safe(spark, sf_dir):
    v = Views(spark, sf_dir)
    rows = v.documents.select("doc_id").join(v.labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.where(F.coalesce(~F.col("quality").isin(0), F.lit(True)))


@query(f"""WITH {ANN} SELECT DISTINCT source_id, image_id FROM ann WHERE label_id IN (3, 5, 8)""")
def class_subset_rederive(spark, sf_dir):
    return Views(spark, sf_dir).ann.where(F.col("label_id").isin(3, 5, 8)).select("source_id", "image_id").distinct()


@query("""SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def union_all_by_name(spark, sf_dir):
    v = Views(spark, sf_dir)
    a = v.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = v.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9500), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 8000)
SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'difference', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL SELECT 'intersection', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""")
def set_ops(spark, sf_dir):
    v = Views(spark, sf_dir)
    a = v.customer.where("c_acctbal > 9500").select(F.col("c_nationkey").alias("k"))
    b = v.supplier.where("s_acctbal > 8000").select(F.col("s_nationkey").alias("k"))
    name = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return name(a.union(b).distinct(), "union").union(name(a.subtract(b), "difference")).union(name(a.intersect(b), "intersection"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def distinct_pairs(spark, sf_dir):
    return Views(spark, sf_dir).lineitem.select("l_orderkey", "l_partkey").distinct().agg(F.count(F.lit(1)).alias("n"))
