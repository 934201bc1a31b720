from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import metrics as M

from .base import Views, query, rounded

_PAIRS = "pairs AS (SELECT l_partkey % 8 AS t, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 8 ELSE l_suppkey % 8 END AS p FROM lineitem WHERE l_partkey % 8 <> 0)"
_CLASS = f"""{_PAIRS}, cls AS (SELECT DISTINCT t AS class FROM pairs UNION SELECT DISTINCT p FROM pairs),
m AS (SELECT class, count(*) FILTER (WHERE t = class AND p = class) AS tp, count(*) FILTER (WHERE t <> class AND p = class) AS fp,
count(*) FILTER (WHERE t = class AND p <> class) AS fn FROM cls, pairs WHERE t = class OR p = class GROUP BY class),
k AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS accuracy, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fp + fn, 0), 0) AS iou FROM m)"""


def _matrix(v):
    t = F.col("l_partkey") % 8
    p = F.when(F.col("l_suppkey") % 3 == 0, t).otherwise(F.col("l_suppkey") % 8)
    return M.confusion(v.lineitem.select(t.alias("t"), p.alias("p")), "t", "p")


@query(f"WITH {_PAIRS} SELECT t AS target, p AS predicted, count(*) AS n FROM pairs GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return _matrix(Views(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT count(*) AS n, round(avg((t = p)::INTEGER), 6) AS accuracy FROM pairs")
def confusion_accuracy(spark, sf_dir):
    out = M.accuracy(_matrix(Views(spark, sf_dir)))
    return out.select(F.col("n").cast("bigint").alias("n"), rounded("accuracy").alias("accuracy"))


@query(f"WITH {_CLASS} SELECT class, tp, fp, fn, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(iou, 6) AS iou FROM k")
def confusion_metrics(spark, sf_dir):
    out = M.per_class(_matrix(Views(spark, sf_dir)))
    return out.withColumns({c: rounded(c) for c in ("accuracy", "f1", "iou")})


@query(f"WITH {_CLASS} SELECT round(avg(accuracy), 6) AS macro_accuracy, round(avg(f1), 6) AS macro_f1, round(avg(iou), 6) AS mean_iou FROM k")
def macro_f1_iou(spark, sf_dir):
    out = M.macro(M.per_class(_matrix(Views(spark, sf_dir))))
    return out.select(*[rounded(c).alias(c) for c in out.columns])


@query("""SELECT p_brand AS concept, round(avg((p_size % 3 = p_partkey % 3)::INTEGER), 6) AS accuracy, count(*) AS n FROM part WHERE p_size % 3 <> 0 GROUP BY 1""")
def concept_accuracy(spark, sf_dir):
    rows = Views(spark, sf_dir).part.select(F.col("p_brand").alias("concept"), (F.col("p_size") % 3).alias("t"), (F.col("p_partkey") % 3).alias("p"))
    return M.concept_accuracies(rows, "concept", "t", "p").withColumn("accuracy", rounded("accuracy"))


@query("""SELECT label, round(coalesce(sum(x) FILTER (WHERE x > 0) / (count(*) FILTER (WHERE x > 0) + 2.0), 0), 6) AS masked,
round(coalesce(sum(-ln(greatest(p, 1e-6))) FILTER (WHERE x > 0) / (count(*) FILTER (WHERE x > 0) + 2.0), 0), 6) AS loss
FROM (SELECT label, embedding[1]::DOUBLE AS x, abs(embedding[2]::DOUBLE) AS p FROM embeddings) GROUP BY label""")
def masked_mean(spark, sf_dir):
    rows = Views(spark, sf_dir).embeddings.select("label", F.col("embedding")[0].cast("double").alias("x"), F.abs(F.col("embedding")[1].cast("double")).alias("p"))
    on = F.col("x") > 0
    return rows.groupBy("label").agg(rounded(M.masked_mean(F.col("x"), on, 2.0)).alias("masked"), rounded(M.rank_loss(F.col("p"), on, 2.0)).alias("loss"))


@query("""WITH b AS (SELECT user_id, event_id, value, max(value) OVER w AS best, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past,
row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
i AS (SELECT *, past IS NULL OR value > past AS improved FROM b)
SELECT user_id, event_id, value, best, improved, cast(nth - max(CASE WHEN improved THEN nth END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS waited FROM i""")
def best_so_far(spark, sf_dir):
    rows = Views(spark, sf_dir).events.select("user_id", "event_id", "value")
    return M.best_so_far(rows, "user_id", "event_id", "value", M.DIRECTION["accuracy"])


_EPOCHS = "(SELECT user_id % 40 AS s, event_id AS e, value AS v FROM events)"


@query(f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY e) AS k FROM {_EPOCHS}),
w AS (SELECT s, k, v AS best, e AS best_epoch, 0 AS waited, NULL::BIGINT AS stop FROM h WHERE k = 1
UNION ALL SELECT w.s, h.k, CASE WHEN h.v - best > 5.0 THEN h.v ELSE best END, CASE WHEN h.v - best > 5.0 THEN h.e ELSE best_epoch END,
  CASE WHEN h.v - best > 5.0 THEN 0 ELSE waited + 1 END, CASE WHEN NOT (h.v - best > 5.0) AND waited + 1 >= 6 THEN h.e END FROM w JOIN h ON h.s = w.s AND h.k = w.k + 1 WHERE w.stop IS NULL)
SELECT s, arg_max(best_epoch, k) AS best_epoch, arg_max(best, k) AS best, max(stop) AS stop_epoch FROM w GROUP BY s""")
def early_stopping(spark, sf_dir):
    rows = Views(spark, sf_dir).events.select((F.col("user_id") % 40).alias("s"), F.col("event_id").alias("e"), F.col("value").alias("v"))
    return M.early_stopping(rows, "s", "e", "v", "max", patience=6, min_delta=5.0)


@query("""SELECT user_id, event_id, round(avg(trunc(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running FROM events""")
def running_loss(spark, sf_dir):
    out = M.running_mean(Views(spark, sf_dir).events.select("user_id", "event_id", F.col("value").cast("int").alias("value")), "user_id", "event_id", "value")
    return out.select("user_id", "event_id", rounded("running").alias("running"))


@query("""WITH c AS (SELECT label, (vec_id + i) % 3 AS y, greatest(least(abs(x::DOUBLE), 1 - 1e-6), 1e-6) AS p FROM (SELECT vec_id, label, unnest(embedding[1:4]) AS x, unnest(generate_series(0, 3)) AS i FROM embeddings))
SELECT label, round(coalesce(sum(-(CASE y WHEN 2 THEN 0.99 ELSE 0.01 END * ln(p) + CASE y WHEN 2 THEN 0.01 ELSE 0.99 END * ln(1 - p))) FILTER (WHERE y > 0) / (count(*) FILTER (WHERE y > 0) + 1.0), 0), 6) AS loss FROM c GROUP BY label""")
def multi_hot_loss(spark, sf_dir):
    rows = Views(spark, sf_dir).embeddings.select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 4)).alias("i", "x"))
    y = (F.col("vec_id") + F.col("i")) % 3
    return rows.groupBy("label").agg(rounded(M.multi_hot_loss(F.abs(F.col("x").cast("double")), y, 1.0)).alias("loss"))


@query("""SELECT user_id, round(sum(CASE event_type WHEN 'purchase' THEN value ELSE value / 7 END), 6) AS concepts FROM events GROUP BY 1""")
def summed_concept_loss(spark, sf_dir):
    part = F.when(F.col("event_type") == "purchase", "multi_hot").otherwise(F.col("event_type"))
    rows = Views(spark, sf_dir).events.select("user_id", part.alias("part"), "value")
    return M.concept_loss(rows, ["user_id"], "part", "value", 7).select("user_id", rounded("concepts").alias("concepts"))


@query("""SELECT user_id % 10 AS epoch, count(*) AS loads, count(*) FILTER (WHERE value > 95) AS failures, round(count(*) FILTER (WHERE value > 95) / count(*), 6) AS rate,
count(*) FILTER (WHERE value > 95) / count(*) > 0.05 AS too_many FROM events GROUP BY 1""")
def load_failure_rates(spark, sf_dir):
    rows = Views(spark, sf_dir).events.select((F.col("user_id") % 10).alias("epoch"), (F.col("value") > 95).alias("failed"))
    return M.failure_rates(rows, "epoch", "failed").withColumn("rate", rounded("rate"))


@query("""SELECT vec_id, i - 1 AS position, round(x::DOUBLE, 6) AS value, CASE WHEN i <= 5 THEN 'name' || (i - 1) ELSE 'class_' || (i - 1) END AS name
FROM (SELECT vec_id, unnest(embedding[1:8]) AS x, unnest(generate_series(1, 8)) AS i FROM embeddings)""")
def metric_unpack(spark, sf_dir):
    v = Views(spark, sf_dir)
    names = v.spark.range(5).select(F.col("id").cast("int").alias("position"), F.concat(F.lit("name"), F.col("id").cast("string")).alias("name"))
    out = M.unpack(v.embeddings.select("vec_id", F.slice("embedding", 1, 8).alias("e")), ["vec_id"], "e", names)
    return out.select("vec_id", F.col("position").cast("bigint").alias("position"), rounded(F.col("value").cast("double")).alias("value"), "name")


@query("""SELECT event_type, round(sum(value) / nullif(count(*), 0), 6) AS per_second, round(100 * count(DISTINCT user_id) / nullif(count(*), 0), 6) AS pct_loading FROM events GROUP BY 1""")
def throughput(spark, sf_dir):
    rate, load = M.throughput(F.sum("value"), F.count(F.lit(1)), F.count_distinct("user_id"))
    return Views(spark, sf_dir).events.groupBy("event_type").agg(rounded(rate).alias("per_second"), rounded(load).alias("pct_loading"))
