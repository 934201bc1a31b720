from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import splits as S

from .base import ANN, SPLIT, Views, query, rounded, split_of


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 100")
def hash_sample_exact_n(spark, sf_dir):
    return S.seeded_sample(Views(spark, sf_dir).orders.select("o_orderkey", "o_totalprice"), F.col("o_orderkey"), 100, seed=7)


@query('SELECT x AS start, least(x + 700, n) AS "end" FROM (SELECT count(*) AS n FROM orders), generate_series(0, n - 1, 700) g(x)')
def batch_ranges(spark, sf_dir):
    return S.batches(Views(spark, sf_dir).orders, 700)


@query("SELECT s_suppkey, cast((row_number() OVER (ORDER BY s_suppkey) - 1) % 7 AS INTEGER) AS shard FROM supplier")
def round_robin_shards(spark, sf_dir):
    return S.round_robin(Views(spark, sf_dir).supplier.select("s_suppkey"), "s_suppkey", 7)


@query(f"""WITH {ANN}, c AS (SELECT label_id, count(*) AS n, count(*) FILTER (WHERE {SPLIT} = 'train') AS train, count(*) FILTER (WHERE {SPLIT} = 'val') AS val,
count(*) FILTER (WHERE {SPLIT} = 'test') AS test FROM ann GROUP BY 1),
s AS (SELECT label_id, train, val, test, n / sum(n) OVER () AS share, train / sum(train) OVER () AS a, val / sum(val) OVER () AS b, test / sum(test) OVER () AS c FROM c)
SELECT label_id, round(share, 6) AS share, round(a, 6) AS train_share, round(b, 6) AS val_share, round(c, 6) AS test_share,
round(greatest(abs(a - share), abs(b - share), abs(c - share)), 6) AS max_deviation, (train > 0)::INTEGER + (val > 0)::INTEGER + (test > 0)::INTEGER AS n_splits,
round(list_stddev_samp([a / share, b / share, c / share]), 6) AS ratio_std FROM s""")
def split_validation(spark, sf_dir):
    rows = Views(spark, sf_dir).ann.withColumn("split", split_of(F.col("tenth")))
    out = S.label_balance(rows, "label_id", "split", ["train", "val", "test"])
    return out.withColumns({c: rounded(c) for c in out.columns if c not in ("label_id", "n_splits")})


@query(f"""WITH {ANN}, s AS (SELECT CASE WHEN label_id < 10 THEN 100 + label_id ELSE source_id END AS source_id, {SPLIT} AS split FROM ann)
SELECT source_id, count(DISTINCT split) AS n_splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def split_shared_sources(spark, sf_dir):
    """Sources made of labels are in several splits, those by order are not."""
    source = F.when(F.col("label_id") < 10, 100 + F.col("label_id")).otherwise(F.col("source_id"))
    rows = Views(spark, sf_dir).ann.select(source.alias("source_id"), split_of(F.col("tenth")).alias("split"))
    return S.shared_sources(rows, "source_id", "split")


@query("""SELECT l_orderkey, count(DISTINCT l_suppkey % 5) AS n_sources FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 5) < 3""")
def split_feasibility(spark, sf_dir):
    rows = Views(spark, sf_dir).lineitem.select("l_orderkey", (F.col("l_suppkey") % 5).alias("src"))
    return S.rare_labels(rows, "l_orderkey", "src")


@query(f"WITH {ANN} SELECT image_id, min({SPLIT}) AS split, count(*) AS n FROM ann GROUP BY 1")
def split_of_image(spark, sf_dir):
    return S.split_of_source(Views(spark, sf_dir).ann.withColumn("split", split_of(F.col("tenth"))), "image_id", "split")


@query()
def greedy_split_best_of_n(spark, sf_dir):
    counts = Views(spark, sf_dir).ann.groupBy("source_id", "label_id").agg(F.count(F.lit(1)).alias("n"))
    return S.balanced_split(counts, "source_id", "label_id", "n", {"train": 0.7, "val": 0.15, "test": 0.15}, trials=100)
