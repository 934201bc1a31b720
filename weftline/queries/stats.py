from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import stats as S

from .base import ANN, IMG, RUNS, SPLIT, Views, query, rounded, split_of

SPLITS = ("train", "val", "test")


def _points(v):
    return v.ann.select(
        split_of(F.col("tenth")).alias("split"), F.col("label_id").alias("target_id"), "image_id", "source_id",
    )


def _classes(v):
    return v.ann.select(F.col("label_id").alias("target_id")).distinct().select(
        "target_id", F.when(F.col("target_id") == 0, "ignore").when(F.col("target_id") == 7, " Unknown").otherwise(F.concat(F.lit("class_"), F.col("target_id").cast("string"))).alias("target_name")
    )


_PTS = f"{ANN}, pts AS (SELECT *, {SPLIT} AS split FROM ann)"
_NAME = "CASE label_id WHEN 0 THEN 'ignore' WHEN 7 THEN ' Unknown' ELSE 'class_' || label_id END"


@query(f"""WITH {_PTS}, t AS (SELECT split, count(*) AS total FROM pts GROUP BY split)
SELECT label_id AS target_id, {_NAME} AS target_name, CASE WHEN label_id = 0 THEN 'background' WHEN label_id = 7 THEN 'unclassified' ELSE 'target' END AS class_kind, """ + ", ".join(
    f"count(*) FILTER (WHERE split = '{s}') AS {s}_annotations, count(DISTINCT image_id) FILTER (WHERE split = '{s}') AS {s}_images, "
    f"round(coalesce(count(*) FILTER (WHERE split = '{s}') / (SELECT total FROM t WHERE split = '{s}'), 0), 6) AS {s}_fraction"
    for s in SPLITS
) + " FROM pts GROUP BY label_id")
def class_counts_by_split(spark, sf_dir):
    v = Views(spark, sf_dir)
    out = S.class_counts(_points(v), _classes(v), SPLITS)
    return out.withColumns({f"{s}_fraction": rounded(f"{s}_fraction") for s in SPLITS})


@query(f"""WITH {_PTS} SELECT 'source' AS source_type, cast(source_id AS VARCHAR) AS source_key, label_id AS target_id, {_NAME} AS target_name, split, count(*) AS annotations, count(DISTINCT image_id) AS images
FROM pts WHERE label_id <> 0 GROUP BY ALL""")
def class_by_source(spark, sf_dir):
    v = Views(spark, sf_dir)
    return S.class_by_source(_points(v), _classes(v))


@query(f"""WITH {_PTS}, {IMG}, im AS (SELECT *, {SPLIT} AS split FROM img),
a AS (SELECT cast(source_id AS VARCHAR) AS source_key, """ + ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}_annotations" for s in SPLITS) + """ FROM pts GROUP BY 1),
b AS (SELECT cast(source_id AS VARCHAR) AS source_key, """ + ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}_images" for s in SPLITS) + """ FROM im GROUP BY 1)
SELECT 'source' AS source_type, source_key, """ + ", ".join(f"coalesce({s}_{n}, 0) AS {s}_{n}" for n in ("images", "annotations") for s in SPLITS) + " FROM a FULL JOIN b USING (source_key)")
def source_stats_by_split(spark, sf_dir):
    v = Views(spark, sf_dir)
    images = v.img.withColumn("split", split_of(F.col("tenth")))
    return S.source_stats(images, _points(v), SPLITS)


@query(f"""WITH {ANN}, {IMG}, c AS (SELECT image_id, count(*) AS n FROM ann WHERE label_id > 9 GROUP BY 1),
e AS (SELECT coalesce(n, 0) AS n FROM (SELECT DISTINCT image_id FROM img) LEFT JOIN c USING (image_id))
SELECT count(*) AS n_images, cast(sum(n) AS BIGINT) AS n_annotations, round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median,
quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.9) AS p90, min(n) AS min, max(n) AS max FROM e""")
def annotations_per_image_quantiles(spark, sf_dir):
    v = Views(spark, sf_dir)
    return S.per_image_summary(v.img, v.ann.where("label_id > 9")).withColumn("mean", rounded("mean"))


@query(f"""WITH {_PTS}, c AS (SELECT label_id, count(*) AS n FROM pts WHERE label_id <> 0 AND split = 'train' GROUP BY 1),
p AS (SELECT n / sum(n) OVER () AS p, row_number() OVER (ORDER BY n DESC, label_id) AS k FROM c)
SELECT round(sum(p) FILTER (WHERE k <= 1), 6) AS top1_share, round(sum(p) FILTER (WHERE k <= 3), 6) AS top3_share,
round(sum(p) FILTER (WHERE k <= 5), 6) AS top5_share, round(exp(-sum(p * ln(p))), 6) AS effective_classes FROM p""")
def topk_share_entropy(spark, sf_dir):
    pts = _points(Views(spark, sf_dir)).where("target_id != 0 and split = 'train'")
    out = S.top_shares(pts, "target_id")
    return out.select(*[rounded(c).alias(c) for c in out.columns])


@query("SELECT 0.0::DOUBLE AS top1_share, 0.0::DOUBLE AS top3_share, 0.0::DOUBLE AS top5_share, 0.0::DOUBLE AS effective_classes")
def topk_share_of_nothing(spark, sf_dir):
    return S.top_shares(_points(Views(spark, sf_dir)).where("target_id < 0"), "target_id")


@query("""SELECT n_regionkey AS region_id, r_name AS region_name, 'region' AS source_type, count(*) AS annotations, count(DISTINCT c_custkey) AS images FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def regions_as_sources(spark, sf_dir):
    """Rows with regions count by region name."""
    v = Views(spark, sf_dir)
    rows = v.customer.join(v.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(v.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("n_regionkey").alias("region_id"), F.col("r_name").alias("region_name"), F.col("c_custkey").cast("string").alias("image_id"), F.lit(1).alias("target_id"), F.lit("train").alias("split"))
    names = rows.select("region_id", "region_name").distinct()
    classes = spark.sql("SELECT 1 AS target_id, 'x' AS target_name")
    out = S.class_by_source(rows, classes).join(names, F.col("source_key") == F.col("region_name"))
    return out.select("region_id", "region_name", "source_type", "annotations", "images")


@query(f"""WITH {ANN}, c AS (SELECT label_id AS label, count(*) AS n FROM ann GROUP BY 1)
SELECT 'even' AS concept, sum(n)::BIGINT AS n FROM c WHERE label % 2 = 0 UNION ALL SELECT 'third', sum(n)::BIGINT FROM c WHERE label % 3 = 0""")
def concept_counts(spark, sf_dir):
    counts = Views(spark, sf_dir).ann.groupBy(F.col("label_id").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    has = lambda name, k: counts.select("label", F.lit(name).alias("concept"), (F.col("label") % k == 0).cast("int").alias("value"))
    return S.concept_counts(counts, has("even", 2).union(has("third", 3)))


@query(f"""WITH {ANN}, {IMG} SELECT image_id, 'load' AS error_type, coalesce(n, 0) AS annotation_count, coalesce(labels, '') AS annotation_labels, n IS NULL AS missing_annotations
FROM img LEFT JOIN (SELECT image_id, count(*) AS n, string_agg(DISTINCT 'L' || label_id, ',' ORDER BY 'L' || label_id) AS labels FROM ann WHERE label_id > 20 GROUP BY 1) USING (image_id) WHERE width IS NULL""")
def failure_report(spark, sf_dir):
    v = Views(spark, sf_dir)
    failed = v.img.where("width is null").select("image_id", F.lit("load").alias("error_type"))
    return S.failure_report(failed, v.ann.where("label_id > 20"), F.concat(F.lit("L"), F.col("label_id").cast("string")))


@query(f"WITH {ANN} SELECT label_id, count(*) AS n FROM ann GROUP BY 1 ORDER BY n DESC, label_id")
def value_counts_tiebreak(spark, sf_dir):
    return S.value_counts(Views(spark, sf_dir).ann, "label_id")


@query(f"""WITH {ANN} SELECT source_id, image_id, string_agg(DISTINCT 'L' || label_id, ',' ORDER BY 'L' || label_id) AS labels FROM ann GROUP BY 1, 2""")
def labels_per_image_csv(spark, sf_dir):
    return S.labels_per_image(Views(spark, sf_dir).ann, F.concat(F.lit("L"), F.col("label_id").cast("string")), ["source_id", "image_id"])


@query(f"""WITH {IMG} SELECT source_id, round(avg(width), 6) AS mean_width, round(stddev_samp(width), 6) AS std_width,
round(100 * stddev_samp(width) / avg(width), 6) AS cv_width, round(avg(width / nullif(height, 0)), 6) AS mean_aspect,
min(width) AS min_width, max(width) AS max_width FROM img GROUP BY 1""")
def dims_cv_by_source(spark, sf_dir):
    out = S.dimension_spread(Views(spark, sf_dir).img, "source_id")
    return out.withColumns({c: rounded(c) for c in ("mean_width", "std_width", "cv_width", "mean_aspect")})


@query(f"""WITH {RUNS} SELECT run, count(*) AS rows, count(DISTINCT source_id) AS sources, count(DISTINCT (source_id, image_id)) AS distinct_keys,
count(*) FILTER (WHERE status = 'completed') AS n_completed, count(*) FILTER (WHERE status = 'failed') AS n_failed,
count(*) FILTER (WHERE status = 'skipped') AS n_skipped, count(*) FILTER (WHERE resize_timestamp IS NULL) AS null_resize_timestamp
FROM runs GROUP BY run""")
def run_comparison(spark, sf_dir):
    a, b = Views(spark, sf_dir).runs
    both = a.withColumn("run", F.lit(0)).unionByName(b.withColumn("run", F.lit(1)))
    return S.run_comparison(both, "run", ["source_id", "image_id"], "status", ["completed", "failed", "skipped"], ["resize_timestamp"])


@query("""SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'TOTAL' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n_orders,
count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def rollup_total_row(spark, sf_dir):
    aggs = [F.count(F.lit(1)).alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers")]
    return S.with_total(Views(spark, sf_dir).orders, "o_orderpriority", aggs)


@query("""SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'TOTAL' ELSE o_orderpriority END AS o_orderpriority,
count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O,
count(*) FILTER (WHERE o_orderstatus = 'P') AS P, count(*) AS "TOTAL" FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def pivot_cube_total(spark, sf_dir):
    return S.pivot_with_total(Views(spark, sf_dir).orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""WITH l AS (SELECT c_mktsegment, c_custkey, unnest([c_mktsegment, 'n' || c_nationkey, c_name]) AS label FROM customer)
SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN 'TOTAL' ELSE c_mktsegment END AS c_mktsegment, count(DISTINCT label) AS n_labels,
count(DISTINCT c_custkey) AS n_images FROM l GROUP BY ROLLUP (c_mktsegment)""")
def unpivot_distinct(spark, sf_dir):
    rows = Views(spark, sf_dir).customer.select(
        "c_mktsegment", "c_custkey", F.col("c_mktsegment").alias("a"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("b"), F.col("c_name").alias("c")
    )
    return S.distinct_over_columns(rows, "c_mktsegment", ["a", "b", "c"], ["c_custkey"])


@query("""SELECT quality AS label, count(*) AS n_annotations, count(DISTINCT cast(doc_id AS VARCHAR)) AS n_images, count(DISTINCT source) AS n_sources
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality""")
def label_stats_null_group(spark, sf_dir):
    v = Views(spark, sf_dir)
    rows = v.documents.select("doc_id", "source").join(v.labels.select("doc_id", "quality"), "doc_id", "left")
    return S.label_stats(rows.select(F.col("quality").alias("label"), F.col("doc_id").cast("string").alias("image_id"), F.col("source").alias("source_id")), "label")


@query("""SELECT quality AS label, count(*) AS n_annotations, count(DISTINCT cast(doc_id AS VARCHAR)) AS n_images, count(DISTINCT source) AS n_sources
FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY quality""")
def label_stats_drop_null(spark, sf_dir):
    v = Views(spark, sf_dir)
    rows = v.documents.select("doc_id", "source").join(v.labels.select("doc_id", "quality"), "doc_id", "left")
    return S.label_stats(rows.select(F.col("quality").alias("label"), F.col("doc_id").cast("string").alias("image_id"), F.col("source").alias("source_id")), "label", keep_null=False)


@query("""WITH c AS (SELECT p_brand, count(*) AS n, CASE WHEN p_brand LIKE '%3' OR p_brand LIKE '%5' THEN lower(p_brand) END AS target FROM part GROUP BY p_brand)
SELECT cast(coalesce(sum(n) FILTER (WHERE target IS NULL), 0) AS BIGINT) AS unmapped, cast(sum(n) AS BIGINT) AS total,
round(100 * coalesce(sum(n) FILTER (WHERE target IS NULL), 0) / sum(n), 2) AS pct FROM c""")
def unmapped_share(spark, sf_dir):
    counts = Views(spark, sf_dir).part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("p_brand").endswith("3") | F.col("p_brand").endswith("5")
    return S.unmapped_share(counts.withColumn("target", F.when(known, F.lower("p_brand"))), "target", "n")


@query(f"""WITH {ANN}, c AS (SELECT label_id, count(*) AS n, 1 / sqrt(count(*) + 1.0) AS w FROM ann GROUP BY 1)
SELECT label_id, n, round(w / avg(w) OVER (), 6) AS weight FROM c""")
def class_weights(spark, sf_dir):
    return S.class_weights(Views(spark, sf_dir).ann, "label_id").withColumn("weight", rounded("weight"))


@query("""SELECT CASE WHEN l_extendedprice < 0 THEN 0 WHEN l_extendedprice >= 100000 THEN 11 ELSE cast(floor(l_extendedprice / 10000) AS BIGINT) + 1 END AS bin,
count(*) AS n FROM lineitem GROUP BY 1""")
def histogram(spark, sf_dir):
    return S.histogram(Views(spark, sf_dir).lineitem, F.col("l_extendedprice"), 0.0, 100000.0, 10)


@query(f"""WITH {ANN}, c AS (SELECT source_id, label_id, count(*) AS n FROM ann GROUP BY 1, 2)
SELECT source_id, label_id, n, cast(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, label_id) AS k FROM c) WHERE k <= 5""")
def topn_per_group(spark, sf_dir):
    return S.top_per_group(Views(spark, sf_dir).ann, "source_id", "label_id", 5)


@query("""WITH t AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 25)
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM t)""")
def nlargest_semi(spark, sf_dir):
    v = Views(spark, sf_dir)
    top = v.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t")).orderBy(F.desc("t"), "o_custkey").limit(25)
    return v.customer.join(top, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query(f"""WITH {IMG} SELECT metric, n, round(100.0 * n / t, 1) AS pct FROM (
SELECT unnest(['has_width', 'needs_resize', 'portrait', 'small']) AS metric,
unnest([count(width), count(*) FILTER (WHERE needs_resize), count(*) FILTER (WHERE height > width), count(*) FILTER (WHERE width < 1000)]) AS n, count(*) AS t FROM img)""")
def audit_flags_onepass(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    flags = {"has_width": w.isNotNull(), "needs_resize": F.col("needs_resize"), "portrait": h > w, "small": w < 1000}
    return S.flag_report(Views(spark, sf_dir).img, flags)


@query("""SELECT unnest(['l_linenumber', 'l_orderkey', 'l_partkey']) AS metric,
unnest([cast(sum(l_linenumber) AS BIGINT), cast(sum(l_orderkey) AS BIGINT), cast(sum(l_partkey) AS BIGINT)]) AS value FROM lineitem""")
def totals_unpivoted(spark, sf_dir):
    return S.totals(Views(spark, sf_dir).lineitem.select("l_linenumber", "l_orderkey", "l_partkey").selectExpr("cast(l_linenumber as bigint) l_linenumber", "l_orderkey", "l_partkey"), ["l_linenumber", "l_orderkey", "l_partkey"])


@query(f"""WITH {ANN}, c AS (SELECT source_id, count(*) AS n FROM ann GROUP BY 1)
SELECT count(*) AS groups, quantile_cont(n, 0.5) AS median, max(n) AS max FROM c""")
def group_size_summary(spark, sf_dir):
    return S.group_size_summary(Views(spark, sf_dir).ann, "source_id")


@query("""SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25,
round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM events""")
def describe_exact(spark, sf_dir):
    out = S.describe(Views(spark, sf_dir).events, "value")
    return out.withColumns({c: rounded(c) for c in ("mean", "std", "q25", "q50", "q75")})


@query(f"""WITH {ANN} SELECT source_id, count(DISTINCT image_id) AS n_images, count(*) AS n_annotations, count(DISTINCT label_id) AS n_labels
FROM ann GROUP BY 1 HAVING count(DISTINCT label_id) >= 10 AND count(*) >= 100""")
def source_summary_having(spark, sf_dir):
    per = Views(spark, sf_dir).ann.groupBy("source_id").agg(
        F.count_distinct("image_id").alias("n_images"), F.count(F.lit(1)).alias("n_annotations"), F.count_distinct("label_id").alias("n_labels")
    )
    return per.where("n_labels >= 10 and n_annotations >= 100")


@query("""SELECT count(DISTINCT p_type) AS raw, count(DISTINCT lower(p_type)) AS lowered, count(DISTINCT split_part(p_type, ' ', 1)) AS first_word FROM part""")
def label_set_sizes(spark, sf_dir):
    p = Views(spark, sf_dir).part
    return p.agg(F.count_distinct("p_type").alias("raw"), F.count_distinct(F.lower("p_type")).alias("lowered"), F.count_distinct(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("first_word"))


@query("""SELECT region, count(*) FILTER (WHERE ok) AS n_valid, count(*) FILTER (WHERE NOT ok) AS n_damaged,
array_to_string(list_slice(list_sort(list(name) FILTER (WHERE NOT ok)), 1, 5), ',') AS damaged_sample
FROM (SELECT p_brand AS region, p_name || '#' || p_partkey AS name, p_size % 7 <> 0 AS ok FROM part) GROUP BY region""")
def valid_and_damaged(spark, sf_dir):
    rows = Views(spark, sf_dir).part.select(
        F.col("p_brand").alias("region"), F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") % 7 != 0).alias("ok")
    )
    sample = F.slice(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("name")))), 1, 5)
    return rows.groupBy("region").agg(
        F.count_if("ok").alias("n_valid"), F.count_if(~F.col("ok")).alias("n_damaged"), F.nullif(F.array_join(sample, ","), F.lit("")).alias("damaged_sample")
    )
