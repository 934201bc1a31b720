from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import registry as R

from .base import Views, query


def _vocab(v):
    return R.vocabulary(v.part.withColumn("src", F.concat(F.lit("s"), (F.col("p_size") % 4).cast("string"))), "src", "p_type")


_VOCAB = """vo AS (SELECT 's' || p_size % 4 AS source, p_type AS label, count(*) AS n FROM part GROUP BY 1, 2),
vocab AS (SELECT *, cast(row_number() OVER (PARTITION BY source ORDER BY label) AS INTEGER) AS local_id FROM vo)"""


@query(f"WITH {_VOCAB} SELECT * FROM vocab")
def vocab_ids(spark, sf_dir):
    return _vocab(Views(spark, sf_dir))


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_brand AS source, p_type AS label, n, cast(row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS INTEGER) AS local_id FROM c""")
def vocab_ids_by_count(spark, sf_dir):
    return R.vocabulary(Views(spark, sf_dir).part, "p_brand", "p_type", by_count=True)


@query("""WITH s AS (SELECT n_regionkey AS r, count(*) AS size FROM nation GROUP BY 1)
SELECT r, size, cast(coalesce(sum(size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM s""")
def running_offsets(spark, sf_dir):
    sizes = Views(spark, sf_dir).nation.groupBy(F.col("n_regionkey").alias("r")).agg(F.count(F.lit(1)).alias("size"))
    return R.offsets(sizes, "r", "size")


@query(f"""WITH {_VOCAB}, o AS (SELECT source, sum(count(*)) OVER (ORDER BY source) - count(*) AS off FROM vocab GROUP BY source)
SELECT source, label, local_id, cast(off + local_id AS BIGINT) AS global_id FROM vocab JOIN o USING (source)""")
def global_ids(spark, sf_dir):
    return R.global_ids(_vocab(Views(spark, sf_dir)))


def _pairs(v):
    labels = v.part.select("p_type").distinct()
    word = F.split_part("p_type", F.lit(" "), F.lit(1))
    return labels.select(F.upper("p_type").alias("label"), F.when(F.length("p_type") % 3 != 0, F.initcap(word)).alias("target"))


_PAIRS = """pairs AS (SELECT DISTINCT lower(p_type) AS label, lower(split_part(p_type, ' ', 1)) AS target FROM part WHERE length(p_type) % 3 <> 0),
targets AS (SELECT target, cast(row_number() OVER (ORDER BY target) AS INTEGER) AS target_id FROM (SELECT DISTINCT target FROM pairs))"""


@query(f"""WITH {_VOCAB}, {_PAIRS} SELECT source, vocab.label, n, local_id, coalesce(target_id, 0) AS target_id FROM vocab
LEFT JOIN pairs ON lower(vocab.label) = pairs.label LEFT JOIN targets USING (target)""")
def source_to_target(spark, sf_dir):
    v = Views(spark, sf_dir)
    pairs = _pairs(v)
    return R.source_to_target(_vocab(v), pairs, R.target_ids(pairs))


def _edges(v):
    """Customers below nations below regions, names in mixed case."""
    low = v.customer.join(F.broadcast(v.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("name"), F.col("n_name").alias("parent"))
    mid = v.nation.join(F.broadcast(v.region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"))
    top = v.region.select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    ring = v.spark.sql("SELECT * FROM VALUES ('loop_a', 'loop_b'), ('loop_b', 'loop_a'), ('orphan', 'nowhere') AS t(name, parent)")
    return low.unionByName(mid).unionByName(top).unionByName(ring)


_EDGES = """edges AS (SELECT lower(c_name) AS name, lower(n_name) AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT lower(n_name), lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT lower(r_name), NULL FROM region UNION ALL VALUES ('loop_a', 'loop_b'), ('loop_b', 'loop_a'), ('orphan', 'nowhere')),
up AS (SELECT name AS label, name AS ancestor, 0 AS depth, [name] AS seen, false AS cycle FROM edges
UNION ALL SELECT up.label, e.parent, up.depth + 1, list_append(up.seen, e.parent), list_contains(up.seen, e.parent) FROM up JOIN edges e ON up.ancestor = e.name
WHERE e.parent IS NOT NULL AND NOT up.cycle)"""


@query(f"WITH RECURSIVE {_EDGES} SELECT label, CASE WHEN NOT bool_or(cycle) THEN max(depth) END AS level FROM up GROUP BY label")
def hierarchy_levels(spark, sf_dir):
    return R.levels(R.ancestors(_edges(Views(spark, sf_dir))))


@query(f"""WITH RECURSIVE {_EDGES}, t AS (SELECT lower(r_name) AS a FROM region WHERE r_regionkey <> 2 UNION SELECT lower(n_name) FROM nation WHERE n_nationkey % 4 = 0)
SELECT label, arg_min(ancestor, depth) FILTER (WHERE ancestor IN (SELECT a FROM t) AND NOT cycle) AS ancestor FROM up GROUP BY label""")
def hierarchy_rollup(spark, sf_dir):
    v = Views(spark, sf_dir)
    targets = v.region.where("r_regionkey != 2").select(F.lower("r_name").alias("target")).union(v.nation.where("n_nationkey % 4 = 0").select(F.lower("n_name")))
    return R.nearest(R.ancestors(_edges(v)), targets)


_CONFLICTS = """pairs AS (SELECT label, arg_max(target, pos) AS target FROM (SELECT DISTINCT lower(p_type) AS label, 'old ' || lower(p_type) AS target, 1 AS pos FROM part
UNION ALL SELECT DISTINCT lower(p_type), 'kind ' || length(p_type), 2 FROM part WHERE length(p_type) % 2 = 0) GROUP BY label),
targets AS (SELECT target, cast(row_number() OVER (ORDER BY target) AS INTEGER) AS target_id FROM (SELECT DISTINCT target FROM pairs))"""


@query(f"""WITH {_VOCAB}, {_CONFLICTS} SELECT source, vocab.label, n, local_id, coalesce(target_id, 0) AS target_id FROM vocab
LEFT JOIN pairs ON lower(vocab.label) = pairs.label LEFT JOIN targets USING (target)""")
def source_to_target_conflicts(spark, sf_dir):
    """Labels that differ by case and have two targets: the last counts, and no vocabulary row doubles."""
    v = Views(spark, sf_dir)
    types = v.part.select("p_type").distinct()
    first = types.select(F.lower("p_type").alias("label"), F.concat(F.lit("old "), "p_type").alias("target"), F.lit(1).alias("position"))
    second = types.where(F.length("p_type") % 2 == 0).select(F.upper("p_type").alias("label"), F.concat(F.lit("Kind "), F.length("p_type").cast("string")).alias("target"), F.lit(2).alias("position"))
    pairs = second.unionByName(first)
    return R.source_to_target(_vocab(v), pairs, R.target_ids(pairs, position="position"), position="position")


@query("""SELECT lower(l) AS label, count(DISTINCT lower(t)) AS n FROM (SELECT upper(p_type) AS l, p_brand AS t FROM part UNION ALL SELECT p_name, p_brand FROM part) GROUP BY 1 HAVING count(DISTINCT lower(t)) > 1""")
def conflicting_targets(spark, sf_dir):
    p = Views(spark, sf_dir).part
    return R.conflicting_targets(p.select(F.upper("p_type").alias("label"), F.col("p_brand").alias("target")).union(p.select("p_name", "p_brand")))


@query("SELECT n_regionkey AS \"offset\", count(*) AS n FROM (SELECT n_regionkey FROM nation UNION ALL SELECT 100 + r_regionkey FROM region) GROUP BY 1 HAVING count(*) > 1")
def overlapping_offsets(spark, sf_dir):
    v = Views(spark, sf_dir)
    return R.overlapping_offsets(v.nation.select(F.col("n_regionkey").alias("offset")).union(v.region.select(100 + F.col("r_regionkey"))))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey AS id, coalesce(cast(n_regionkey AS INTEGER), 0) AS target_id FROM lineitem LEFT JOIN nation ON n_nationkey = l_suppkey""")
def dense_lookup(spark, sf_dir):
    """Source ids to target ids by a lookup table; ids outside it are background."""
    v = Views(spark, sf_dir)
    ids = v.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("id"))
    table = v.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("int").alias("target_id"))
    return R.dense_ids(ids, table, "id", "target_id").select("l_orderkey", "l_linenumber", "id", "target_id")


@query("""WITH t AS (SELECT *, row_number() OVER (ORDER BY target) AS target_id FROM (SELECT DISTINCT lower(n_name) AS target FROM nation WHERE n_regionkey IN (0, 2)))
SELECT target, cast(target_id AS INTEGER) AS target_id FROM t""")
def target_subset(spark, sf_dir):
    v = Views(spark, sf_dir)
    keep = [r[0].upper() for r in v.nation.where("n_regionkey IN (0, 2)").select("n_name").collect()]
    return R.target_ids(v.nation.select(F.col("n_name").alias("label"), F.col("n_name").alias("target")), subset=keep)


@query("""SELECT doc_id, n.name AS archived, m.name AS host, NULL::VARCHAR AS second FROM documents LEFT JOIN labels USING (doc_id)
JOIN (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 20) n ON n.id = doc_id % 25
LEFT JOIN (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 20) m ON m.id = quality * 15 + doc_id % 10""")
def wide_annotators(spark, sf_dir):
    """An unknown archived label drops the row; other annotators may be blank, unknown or absent."""
    v = Views(spark, sf_dir)
    rows = v.documents.select("doc_id").join(v.labels.select("doc_id", "quality"), "doc_id", "left").select(
        "doc_id", (F.col("doc_id") % 25).cast("string").alias("archived"), F.coalesce((F.col("quality") * 15 + F.col("doc_id") % 10).cast("string"), F.lit(" ")).alias("host")
    )
    names = v.nation.where("n_nationkey < 20").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"))
    return R.wide_annotations(rows, names, "archived", ["host", "second"])


@query("SELECT n_name AS name, n_nationkey AS position FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def vocabulary_in_order(spark, sf_dir):
    v = Views(spark, sf_dir)
    fixed = v.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("position"))
    chosen = v.supplier.where("s_acctbal > 5000").join(v.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"))
    return R.in_order(chosen, fixed, "name", "position")


@query("""WITH c AS (SELECT 'l' || p_partkey AS label, 'd' || p_partkey % 3 AS dataset, 'l' || p_partkey // 2 AS target,
    CASE WHEN p_partkey < 20 THEN 'goal' ELSE 'd' || (p_partkey // 2) % 3 END AS td FROM part WHERE p_partkey % 9 <> 0)
SELECT label, dataset, reached FROM (WITH RECURSIVE w AS (SELECT label, dataset, target AS spot, td, 1 AS depth FROM c
UNION ALL SELECT w.label, w.dataset, c.target, c.td, depth + 1 FROM w JOIN c ON w.spot = c.label AND w.td = c.dataset WHERE w.td <> 'goal' AND depth < 20)
SELECT label, dataset, max(spot) FILTER (WHERE td = 'goal') AS reached FROM w GROUP BY 1, 2)""")
def chain_map(spark, sf_dir):
    k = F.col("p_partkey")
    half = F.expr("p_partkey div 2")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    pairs = Views(spark, sf_dir).part.where(k % 9 != 0).select(
        name("l", k).alias("label"), name("d", k % 3).alias("dataset"), name("l", half).alias("target"),
        F.when(k < 20, "goal").otherwise(name("d", half % 3)).alias("target_dataset"),
    )
    return R.follow_chain(pairs, "goal")


@query("""WITH l AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN upper(p_type) WHEN p_size % 3 = 1 THEN lower(p_type) ELSE p_type END AS label FROM part)
SELECT label, first_value(label) OVER (PARTITION BY lower(label) ORDER BY label = upper(label), label) AS canonical FROM l""")
def canonical_case(spark, sf_dir):
    s = F.col("p_size") % 3
    label = F.when(s == 0, F.upper("p_type")).when(s == 1, F.lower("p_type")).otherwise(F.col("p_type"))
    return R.canonical_spelling(Views(spark, sf_dir).part.select(label.alias("label")), "label")


@query("""SELECT doc_id, coalesce(quality, CASE WHEN doc_id % 2 = 0 THEN 9 END) AS label, CASE WHEN quality IS NOT NULL THEN 'host' WHEN doc_id % 2 = 0 THEN 'archived' END AS annotator
FROM documents LEFT JOIN labels USING (doc_id)""")
def annotator_fallback(spark, sf_dir):
    v = Views(spark, sf_dir)
    rows = v.documents.select("doc_id").join(v.labels.select("doc_id", "quality"), "doc_id", "left")
    label, who = R.pick_annotator(F.col("quality"), F.when(F.col("doc_id") % 2 == 0, F.lit(9)), "host", "archived")
    return rows.select("doc_id", label.alias("label"), who.alias("annotator"))


@query(f"""WITH {_PAIRS}, l AS (SELECT DISTINCT lower(p_type) AS label FROM part), b AS (SELECT DISTINCT lower(p_type) AS label, p_type AS target FROM part WHERE length(p_type) % 2 = 0)
SELECT l.label, upper(substr(coalesce(pairs.target, b.target), 1, 1)) || lower(substr(coalesce(pairs.target, b.target), 2)) AS target
FROM l LEFT JOIN pairs USING (label) LEFT JOIN b ON b.label = l.label""")
def final_label_map(spark, sf_dir):
    v = Views(spark, sf_dir)
    types = v.part.select("p_type").distinct()
    second = types.where(F.length("p_type") % 2 == 0).select(F.lower("p_type").alias("label"), F.col("p_type").alias("target"))
    return R.final_map(types.select(F.lower("p_type").alias("label")).distinct(), R.label_map(_pairs(v)), second)
