from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import concepts as C

from .base import Views, query, rounded

_ROWS = """rows AS (SELECT p_partkey, p_type AS label, CASE WHEN p_size % 5 = 0 THEN 'not_given' ELSE split_part(p_brand, '#', 2) END AS genus,
CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'f' || p_size % 3 END AS family, CASE p_size % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'FALSE' ELSE 'not_given' END AS hard,
CASE p_size % 2 WHEN 0 THEN 'TRUE' ELSE 'not_given' END AS soft FROM part)"""
_GENERA = "g AS (SELECT genus, row_number() OVER (ORDER BY genus) AS id FROM (SELECT DISTINCT genus FROM rows WHERE genus <> 'not_given'))"


def _rows(v):
    s = F.col("p_size")
    return v.part.select(
        "p_partkey", F.col("p_type").alias("label"),
        F.when(s % 5 == 0, "not_given").otherwise(F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("genus"),
        F.when(s % 7 != 0, F.concat(F.lit("f"), (s % 3).cast("string"))).alias("family"),
        F.when(s % 3 == 0, "TRUE").when(s % 3 == 1, "FALSE").otherwise("not_given").alias("hard"),
        F.when(s % 2 == 0, "TRUE").otherwise("not_given").alias("soft"),
    )


@query(f"WITH {_ROWS}, {_GENERA} SELECT genus AS value, cast(id AS INTEGER) AS id FROM g UNION ALL SELECT 'not_given', 0")
def taxonomy_ids(spark, sf_dir):
    return C.taxonomy_ids(_rows(Views(spark, sf_dir)), "genus")


@query(f"""WITH {_ROWS}, {_GENERA} SELECT p_partkey, array_to_string(list_transform((SELECT list(genus ORDER BY genus) FROM g),
lambda x: CASE WHEN rows.genus = 'not_given' THEN 0 WHEN rows.genus = x THEN 2 ELSE 1 END), ',') AS vector FROM rows""")
def taxonomy_binary_encode(spark, sf_dir):
    rows = _rows(Views(spark, sf_dir))
    vector = C.binary_vector(F.col("genus"), C.rank_values(rows, "genus"))
    return rows.select("p_partkey", F.array_join(vector.cast("array<string>"), ",").alias("vector"))


@query(f"""WITH {_ROWS} SELECT p_partkey, CASE hard WHEN 'TRUE' THEN 2 WHEN 'FALSE' THEN 1 ELSE 0 END AS hard, 'hard' AS kept FROM rows""")
def binary_concepts(spark, sf_dir):
    rows = _rows(Views(spark, sf_dir))
    kept = C.meaningful_traits(rows, ["hard", "soft"])
    return rows.select("p_partkey", C.binary_trait(F.col("hard")).alias("hard"), F.lit(",".join(kept)).alias("kept"))


@query(f"""WITH {_ROWS}, f AS (SELECT DISTINCT family FROM rows WHERE family IS NOT NULL),
e AS (SELECT p_partkey, label, list_concat(list_transform((SELECT list(family ORDER BY family) FROM f),
    lambda x: CASE WHEN rows.family IS NULL THEN 0 WHEN rows.family = x THEN 2 ELSE 1 END), [CASE hard WHEN 'TRUE' THEN 2 WHEN 'FALSE' THEN 1 ELSE 0 END]) AS ch FROM rows),
l AS (SELECT label, row_number() OVER (ORDER BY label) AS global_id FROM (SELECT DISTINCT label FROM rows)),
z AS (SELECT label, arg_max(ch, p_partkey) AS ch FROM e WHERE length(label) % 2 = 0 GROUP BY 1)
SELECT global_id, array_to_string(coalesce(ch, [0, 0, 0, 0]), ',') AS channels FROM l LEFT JOIN z USING (label) UNION ALL SELECT 0, '0,0,0,0'""")
def concept_matrix(spark, sf_dir):
    rows = _rows(Views(spark, sf_dir))
    encoded = C.encode_channels(rows, ["family"], ["hard", "soft"]).withColumnRenamed("p_partkey", "position")
    from weftline.operators.registry import vocabulary

    labels = vocabulary(rows.withColumn("s", F.lit("s")), "s", "label").select(F.col("local_id").alias("global_id"), "label")
    out = C.concept_matrix(labels, encoded.where(F.length("label") % 2 == 0), 4)
    return out.select("global_id", F.array_join(F.col("channels").cast("array<string>"), ",").alias("channels"))


@query("""WITH c AS (SELECT DISTINCT upper(p_type) AS label, p_brand AS source, length(p_type) AS trait FROM part),
l AS (SELECT DISTINCT p_type AS label, CASE WHEN p_size % 5 = 0 THEN 'brand#x' ELSE lower(p_brand) END AS source FROM part)
SELECT lower(l.label) AS label, l.source, cast(length(l.label) * 100 + length(l.source) AS BIGINT) AS global_id, cast(trait AS INTEGER) AS trait
FROM c RIGHT JOIN l ON lower(c.label) = lower(l.label) AND lower(c.source) = l.source""")
def right_join_concepts(spark, sf_dir):
    p = Views(spark, sf_dir).part
    concepts = p.select(F.upper("p_type").alias("label"), F.col("p_brand").alias("source"), F.length("p_type").alias("trait")).distinct()
    named = F.when(F.col("p_size") % 5 == 0, "brand#x").otherwise(F.lower("p_brand"))
    labels = p.select(F.col("p_type").alias("label"), named.alias("source")).distinct()
    labels = labels.withColumn("global_id", (F.length("label") * 100 + F.length("source")).cast("bigint"))
    return C.with_concepts(concepts, labels).select("label", "source", "global_id", "trait")


@query(f"""WITH {_ROWS} SELECT genus AS child, arg_min(family, p_partkey) AS parent FROM rows WHERE genus <> 'not_given' AND family IS NOT NULL GROUP BY 1""")
def taxonomy_parents(spark, sf_dir):
    return C.taxonomy_parents(_rows(Views(spark, sf_dir)), ["family", "genus"], "p_partkey")


@query("""SELECT split_part(n, '__', 1) AS rank, min(k) AS first, count(*) AS width FROM (SELECT p_partkey AS k, p_brand || '__' || p_type AS n FROM part WHERE p_partkey % 3 <> 0) GROUP BY 1""")
def rank_groups(spark, sf_dir):
    k = F.col("p_partkey")
    names = Views(spark, sf_dir).part.select(k.alias("k"), F.when(k % 3 != 0, F.concat("p_brand", F.lit("__"), "p_type")).otherwise(F.col("p_brand")).alias("n"))
    return C.rank_groups(names, "k", "n")


@query("""SELECT vec_id, cast(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best, cast(list_position(embedding[1:8], list_max(embedding[1:8])) - 1 AS INTEGER) AS first_slice,
cast(list_position(embedding[9:24], list_max(embedding[9:24])) - 1 AS INTEGER) AS second_slice FROM embeddings""")
def argmax_channels(spark, sf_dir):
    a, b = C.channel_slices(F.col("embedding"), [8, 16])
    return Views(spark, sf_dir).embeddings.select(
        "vec_id", C.first_argmax(F.col("embedding")).alias("best"), C.first_argmax(a).alias("first_slice"), C.first_argmax(b).alias("second_slice")
    )


@query("""SELECT vec_id, cast(i - 1 AS INTEGER) AS position, round(x::DOUBLE, 6) AS value FROM (SELECT vec_id, i, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS k
FROM (SELECT vec_id, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)) WHERE k <= 3""")
def topk_channels(spark, sf_dir):
    rows = Views(spark, sf_dir).embeddings.select("vec_id", F.inline(C.top_k(F.col("embedding"), 3)))
    return rows.select("vec_id", "position", rounded(F.col("value").cast("double")).alias("value"))


_LEVELS = [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def _level_sql():
    step = lambda a: f"WHEN greatest(embedding[{a}], embedding[{a + 1}]) > 0.15::FLOAT THEN CASE WHEN embedding[{a}] >= embedding[{a + 1}] THEN {a - 1} ELSE {a} END"
    return "CASE " + " ".join(step(a) for a in (9, 7, 5, 3, 1)) + " ELSE -1 END"


@query(f"SELECT vec_id, {_level_sql()} AS label FROM embeddings")
def hierarchical_argmax(spark, sf_dir):
    import struct

    least = struct.unpack("f", struct.pack("f", 0.15))[0]
    return Views(spark, sf_dir).embeddings.select("vec_id", C.hierarchical_argmax(F.col("embedding"), _LEVELS, least).alias("label"))


@query("""SELECT vec_id, CASE WHEN s = 0 THEN 0 ELSE cast(list_position(c, list_max(c)) AS INTEGER) END AS dense, cast(greatest(coalesce(list_position(c, 2), 0) - 1, 0) AS INTEGER) AS target, list_contains(c, 2) AS valid
FROM (SELECT vec_id, c, list_sum(c) AS s FROM (SELECT vec_id, list_transform(embedding[1:6], lambda x: CASE WHEN label = 3 THEN 0 WHEN x > 0.1::FLOAT THEN 2 ELSE 1 END) AS c FROM embeddings))""")
def taxonomy_dense(spark, sf_dir):
    c = F.transform(F.slice("embedding", 1, 6), lambda x: F.when(F.col("label") == 3, 0).when(x > F.lit(0.1).cast("float"), 2).otherwise(1))
    rows = Views(spark, sf_dir).embeddings.select("vec_id", c.alias("c"))
    target, valid = C.dense_target(F.col("c"))
    return rows.select("vec_id", C.dense_id(F.col("c")).alias("dense"), target.alias("target"), valid.alias("valid"))
