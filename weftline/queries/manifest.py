from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import manifest as M

from .base import ANN, IMG, LATEST, RUNS, Views, query

_W, _H = "cast(floor(width * (2048.0::DOUBLE / greatest(width, height))) AS INTEGER)", "cast(floor(height * (2048.0::DOUBLE / greatest(width, height))) AS INTEGER)"


@query(f"""WITH {ANN}, {IMG}, {RUNS}, {LATEST},
m AS (SELECT *, needs_resize AND coalesce(status, '') = 'completed' AS use FROM img LEFT JOIN latest USING (source_id, image_id)),
u AS (SELECT *, CASE WHEN use THEN {_W} ELSE width END AS lw, CASE WHEN use THEN {_H} ELSE height END AS lh,
    CASE WHEN use THEN 'data/resized/s' || source_id || '/images/' || image_id || '.jpg' ELSE s3_key END AS key
    FROM m WHERE (NOT needs_resize OR use) AND width > 0 AND height > 0)
SELECT source_id, image_id,
    cast(greatest(least(floor(row * (lh::DOUBLE / height)), lh - 1), 0) AS SMALLINT) AS row,
    cast(greatest(least(floor(col * (lw::DOUBLE / width)), lw - 1), 0) AS SMALLINT) AS col,
    label_id, cast(label_id AS VARCHAR) AS source_label_name, key AS image_s3_key,
    cast(lw AS SMALLINT) AS load_width, cast(lh AS SMALLINT) AS load_height, use AS uses_resized_image
FROM ann JOIN u USING (source_id, image_id)""")
def training_manifest(spark, sf_dir):
    v = Views(spark, sf_dir)
    return M.training_manifest(v.ann, v.img, M.latest_rows(v.runs))


@query(f"""WITH {IMG}, {RUNS}, {LATEST}
SELECT source_id, image_id, status, resize_timestamp, width AS original_width, height AS original_height,
    CASE WHEN width IS NOT NULL AND greatest(width, height) > 2048 THEN {_W} ELSE width END AS resized_width,
    CASE WHEN width IS NOT NULL AND greatest(width, height) > 2048 THEN {_H} ELSE height END AS resized_height,
    'data/resized/s' || source_id || '/images/' || image_id || '.jpg' AS output_s3_key
FROM img JOIN latest USING (source_id, image_id) WHERE cast(image_id AS BIGINT) % 31 <> 0""")
def resize_manifest(spark, sf_dir):
    v = Views(spark, sf_dir)
    checkpoint = M.latest_rows(v.runs).withColumn("status", F.when(F.col("image_id").cast("bigint") % 31 != 0, F.col("status")))
    return M.resize_manifest(v.img, checkpoint)


@query(f"WITH {RUNS}, {LATEST} SELECT * FROM latest")
def combine_runs_latest(spark, sf_dir):
    return M.latest_rows(Views(spark, sf_dir).runs)


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (
    PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def keep_last_dedup(spark, sf_dir):
    rows = Views(spark, sf_dir).events.select("user_id", "event_type", "event_id", "value")
    return M.newest(rows, ["user_id", "event_type"], [F.col("event_id").desc()])


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (
    PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1""")
def keep_first_dedup(spark, sf_dir):
    rows = Views(spark, sf_dir).events.select("user_id", "event_type", "event_id", "value")
    return M.newest(rows, ["user_id", "event_type"], [F.col("event_id")])


@query("""WITH p AS (SELECT (event_id * 7919) % 1009 AS page, event_id AS pos, user_id, value FROM events)
SELECT user_id, page, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY page, pos) AS k FROM p) WHERE k = 1""")
def first_seen_by_page(spark, sf_dir):
    rows = Views(spark, sf_dir).events.select("user_id", ((F.col("event_id") * 7919) % 1009).alias("page"), F.col("event_id").alias("pos"), "value")
    return M.newest(rows, ["user_id"], [F.col("page"), F.col("pos")])
