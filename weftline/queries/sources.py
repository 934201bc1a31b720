"""Readers and writers: each query writes a fixture from the driver's tables to the scratch folder and reads it back."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from weftline import schemas
from weftline.functions import images as I
from weftline.functions import text as T
from weftline.operators import registry as R
from weftline.operators import stats as S
from weftline.operators import workqueue as Q
from weftline.operators.splits import seeded_sample
from weftline.plans.scratch import scratch_dir
from weftline.sources import files, sinks

from .base import ANN, IMG, Views, query


def _folder(spark) -> str:
    return f"{scratch_dir(spark)}/weftline/fixture-{uuid.uuid4().hex}"


def _lines(df, path):
    """Lines of text in one file, in order (fixtures are made of dimension tables)."""
    df.coalesce(1).write.text(path)
    return path


@query("""SELECT p_name || ', "x"' AS name, cast(p_partkey AS VARCHAR) AS "Row", CASE WHEN p_partkey % 5 <> 0 THEN cast(p_size AS VARCHAR) END AS "Column" FROM part""")
def csv_ragged(spark, sf_dir):
    """Quoted commas and quotes; every fifth row is short and every third long."""
    part = Views(spark, sf_dir).part
    cells = F.concat_ws(",", F.concat(F.lit('"'), "p_name", F.lit(', ""x"""')), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("string")), F.when((F.col("p_partkey") % 5 != 0) & (F.col("p_partkey") % 3 == 0), "more"))
    path = _lines(spark.range(1).select(F.lit("name,Row,Column").alias("value")).union(part.select(cells)), _folder(spark))
    return files.read_text_csv(spark, path)


@query("SELECT true AS missing_is_none, true AS no_rows, 'source_id,image_id,s3_key,width,height,longest_edge,file_size,needs_resize,header_status,error_message' AS columns")
def missing_files(spark, sf_dir):
    path = _folder(spark)
    none = files.read_text_csv(spark, f"{path}/none.csv") is None and files.non_blank_rows(spark, f"{path}/none.csv") is None
    parts = files.read_parts(spark, path, schemas.IMAGES)
    return parts.agg(F.lit(none).alias("missing_is_none"), (F.count(F.lit(1)) == 0).alias("no_rows"), F.lit(",".join(parts.columns)).alias("columns"))


@query("SELECT cast(n_nationkey AS INTEGER) AS id, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (1, 4, 9)")
def memory_relation(spark, sf_dir):
    v = Views(spark, sf_dir)
    ids = spark.createDataFrame([(1,), (4,), (9,), (None,)], "id int")
    rows = ids.join(v.nation, F.col("id") == F.col("n_nationkey")).join(v.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("id", F.col("n_name").alias("name"), F.col("r_name").alias("region"))


def _tree(v) -> str:
    """A folder for each nation, with annotation files everywhere and image lists and images here and there; two folders that are no sources."""
    spark, root = v.spark, _folder(v.spark)
    for r in v.nation.orderBy("n_nationkey").collect():  # 25 nations
        k = r.n_nationkey
        sinks.put_text(spark, f"{root}/s{k}/annotations.csv", f"Name,Row\n{r.n_name}.jpg,{k}\n")
        if k % 2:
            sinks.put_text(spark, f"{root}/s{k}/image_list.csv", f"Name,Image Page\n{r.n_name}.jpg,/image/{100 + k}/view/\n")
        for i in range(k % 4):
            sinks.put_text(spark, f"{root}/s{k}/images/{i}.jpg", "x" * (i + 1))
    for bad in ("sX", "other"):
        sinks.put_text(spark, f"{root}/{bad}/annotations.csv", "Name,Row\nno,1\n")
    return root


@query("""SELECT cast(n_nationkey AS INTEGER) AS source_id, CASE WHEN n_nationkey % 2 = 1 THEN 'annotations.csv,image_list.csv' ELSE 'annotations.csv' END AS files FROM nation""")
def source_folders(spark, sf_dir):
    return files.list_sources(spark, _tree(Views(spark, sf_dir))).withColumn("files", F.array_join("files", ","))


@query("SELECT cast(n_nationkey AS INTEGER) AS source_id FROM nation WHERE n_nationkey % 2 = 1")
def source_whitelist(spark, sf_dir):
    return files.sources_with(files.list_sources(spark, _tree(Views(spark, sf_dir))))


@query("SELECT cast(n_nationkey AS INTEGER) AS source_id, n_nationkey % 4 AS n_images, (n_nationkey % 4) * (n_nationkey % 4 + 1) // 2 AS bytes FROM nation WHERE n_nationkey % 4 > 0")
def image_objects(spark, sf_dir):
    found = files.image_objects(spark, _tree(Views(spark, sf_dir)))
    return found.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_images"), F.sum("length").alias("bytes"))


@query("SELECT cast(n_nationkey AS INTEGER) AS source_id, n_name || '.jpg' AS \"Name\", cast(n_nationkey AS VARCHAR) AS \"Row\" FROM nation")
def source_csvs(spark, sf_dir):
    return files.read_source_csvs(spark, _tree(Views(spark, sf_dir)), "annotations.csv", ["Name", "Row"])


@query("SELECT cast(o_orderkey % 50 AS INTEGER) AS source_id, o_orderkey || '.v2' AS image_id, 'completed' AS status FROM orders WHERE o_orderkey % 3 <> 0")
def resized_listing(spark, sf_dir):
    k = F.col("o_orderkey")
    folder = F.when(k % 3 != 0, "data/resized/s").otherwise("data/s")
    paths = Views(spark, sf_dir).orders.select(F.concat(folder, (k % 50).cast("string"), F.lit("/images/"), k.cast("string"), F.lit(".v2.jpg")).alias("path"))
    return files.resized_listing(paths)


@query("""SELECT CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS image, p_type AS kind FROM part""")
def csv_alias_columns(spark, sf_dir):
    """One of two columns holds the image, the other is blank; cells follow a space."""
    even = F.col("p_partkey") % 2 == 0
    line = F.concat(F.when(even, "").otherwise(F.col("p_name")), F.lit(", "), F.when(even, F.col("p_brand")).otherwise(" "), F.lit(", "), "p_type")
    rows = spark.range(1).select(F.lit("imagefile, image, kind").alias("value")).union(Views(spark, sf_dir).part.select(line))
    df = files.read_text_csv(spark, _lines(rows, _folder(spark)))
    return df.select(files.first_filled("imagefile", "image").alias("image"), "kind")


@query("SELECT cast(p_partkey AS INTEGER) AS row, cast(p_size AS INTEGER) AS col, p_type AS label FROM part WHERE p_partkey % 7 NOT IN (1, 2, 3, 4)")
def point_text(spark, sf_dir):
    """Notes, short lines, points off and cells that are no numbers drop out."""
    k = F.col("p_partkey")
    full = F.concat_ws(";", k.cast("string"), F.col("p_size").cast("string"), "p_type")
    line = F.when(k % 7 == 1, F.concat(F.lit("# "), full)).when(k % 7 == 2, F.concat(F.lit("1;"), "p_type")).when(k % 7 == 3, "1;2;OFF").when(k % 7 == 4, "x;2;coral").otherwise(full)
    return files.read_point_text(spark, _lines(Views(spark, sf_dir).part.select(line.alias("value")), _folder(spark)))


@query("SELECT n_name AS label, CASE WHEN n_nationkey % 3 <> 0 THEN cast(n_regionkey AS VARCHAR) END AS target FROM nation")
def json_map(spark, sf_dir):
    path = f"{_folder(spark)}/map.json"
    pairs = F.map_from_entries(F.collect_list(F.struct("n_name", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey").cast("string")))))
    sinks.put_text(spark, path, Views(spark, sf_dir).nation.agg(F.to_json(pairs, {"ignoreNullFields": "false"})).first()[0])
    return files.read_json_map(spark, path)


@query("SELECT cast(r_regionkey AS INTEGER) AS id, r_name AS name FROM region")
def literal_map(spark, sf_dir):
    path = f"{_folder(spark)}/labels.py"
    body = ", ".join(f"{r.r_regionkey}: '{r.r_name}'" for r in Views(spark, sf_dir).region.collect())
    sinks.put_text(spark, path, f"labels = {{{body}}}\n")
    return files.read_literal_map(spark, path)


@query("SELECT o_orderkey, o_orderpriority AS split FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus <> 'P'")
def named_splits(spark, sf_dir):
    """Two splits of a dataset and a filter on them; a name that it lacks is refused."""
    path = _folder(spark)
    Views(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("split")).write.parquet(path)
    try:
        files.read_split(spark, path, ["no such split"])
    except ValueError:
        return files.read_split(spark, path, ["1-URGENT", "5-LOW"]).where("o_orderstatus != 'P'").select("o_orderkey", "split")
    raise AssertionError("an unknown split was read")


@query("""SELECT 'text' AS given, unnest([1, 3, 12])::INTEGER AS source_id UNION ALL SELECT 'csv', cast(n_nationkey AS INTEGER) FROM nation UNION ALL SELECT 'parquet', cast(n_nationkey AS INTEGER) FROM nation""")
def id_lists(spark, sf_dir):
    root, nation = _folder(spark), Views(spark, sf_dir).nation.select(F.col("n_nationkey").alias("source_id"))
    sinks.write_csv(nation.union(nation), f"{root}/ids.csv")
    nation.write.parquet(f"{root}/ids.parquet")
    given = {"text": files.id_list(spark, " 3,12, x,1,3"), "csv": files.id_list(spark, path=f"{root}/ids.csv"), "parquet": files.id_list(spark, path=f"{root}/ids.parquet")}
    named = [df.select(F.lit(k).alias("given"), "source_id") for k, df in given.items()]
    return named[0].union(named[1]).union(named[2])


@query("SELECT o_orderkey, batch::INTEGER AS batch_id FROM (SELECT o_orderkey, 0 AS batch FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 3 = 1)")
def parts_with_a_broken_one(spark, sf_dir):
    """Parts get rising numbers; one that cannot be read is passed over."""
    path, orders = _folder(spark), Views(spark, sf_dir).orders.select("o_orderkey")
    for i in range(2):
        sinks.append_part(orders.where(F.col("o_orderkey") % 3 == i), path, sinks.next_batch(spark, path))
    sinks.put_text(spark, f"{path}/broken.parquet", "no parquet")
    kind = spark.createDataFrame([], "o_orderkey long, batch_id int").schema
    return files.read_parts(spark, path, kind)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def unseen_after_parts(spark, sf_dir):
    """Rows whose key no readable part has."""
    path, orders = _folder(spark), Views(spark, sf_dir).orders.select("o_orderkey")
    sinks.append_part(orders.where("o_orderkey % 3 = 0"), path, 0)
    return Q.unseen(orders, files.read_parts(spark, path, orders.schema), ["o_orderkey"])


@query("SELECT 4 AS rows, true AS missing_is_null")
def non_blank_rows(spark, sf_dir):
    path = f"{_folder(spark)}/a.csv"
    sinks.put_text(spark, path, "h\n1\n\n2\n  \n3\n4\n")
    none = files.non_blank_rows(spark, f"{path}.none") is None
    return spark.range(1).select(F.lit(files.non_blank_rows(spark, path)).alias("rows"), F.lit(none).alias("missing_is_null"))


@query(f"WITH {ANN} SELECT source_id, image_id, row, col, label_id, NULL::VARCHAR AS status, true AS in_order, true AS same_digest FROM ann")
def sorted_table(spark, sf_dir):
    """A table in key order: no row lies before the one written ahead of it, and its digest is that of the rows."""
    path, keys = _folder(spark), list(schemas.KEYS["annotations"])
    rows = schemas.conform(Views(spark, sf_dir).ann.withColumn("status", F.lit(None)), schemas.ANNOTATIONS)
    sinks.write_sorted(rows, path, schemas.ANNOTATIONS, keys)
    back = spark.read.parquet(path)
    at = back.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    from pyspark.sql import Window

    before = F.lag(F.struct(*keys)).over(Window.partitionBy("_file").orderBy("_row"))
    good = at.withColumn("_ok", F.coalesce(before <= F.struct(*keys), F.lit(True)))
    return good.select(*back.columns, F.col("_ok").alias("in_order"), F.lit(sinks.digest(back) == sinks.digest(rows)).alias("same_digest"))


@query("SELECT r_regionkey, r_name FROM region")
def replaced_table(spark, sf_dir):
    """The second version of a table; the first is gone."""
    path, v = _folder(spark), Views(spark, sf_dir)
    sinks.replace_table(v.nation, path)
    sinks.replace_table(v.region.select("r_regionkey", "r_name"), path)
    return sinks.read_table(spark, path)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def parquet_written(spark, sf_dir):
    path = _folder(spark)
    Views(spark, sf_dir).supplier.select("s_suppkey", "s_name", "s_acctbal").write.parquet(path)
    return spark.read.parquet(path)


@query("""SELECT cast(s_suppkey AS VARCHAR) AS s_suppkey, s_name || ', "Ltd"' AS s_name FROM supplier""")
def csv_written(spark, sf_dir):
    path = _folder(spark)
    rows = Views(spark, sf_dir).supplier.select("s_suppkey", F.concat("s_name", F.lit(', "Ltd"')).alias("s_name"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.read_text_csv(spark, path)


@query("SELECT n_nationkey, n_name FROM nation")
def json_written(spark, sf_dir):
    path = _folder(spark)
    sinks.write_json(Views(spark, sf_dir).nation.select("n_nationkey", "n_name"), path)
    return spark.read.schema("n_nationkey int, n_name string").json(path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("SELECT unnest(['n: ' || count(*), 'least: ' || min(n_name)]) AS line FROM nation")
def summary_written(spark, sf_dir):
    path = f"{_folder(spark)}/summary.yaml"
    sinks.write_summary(Views(spark, sf_dir).nation.agg(F.count(F.lit(1)).alias("n"), F.min("n_name").alias("least")), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("""WITH vo AS (SELECT DISTINCT 's' || p_size % 3 AS source, p_type AS label FROM part), l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY label) AS local_id FROM vo),
o AS (SELECT source, coalesce(sum(count(*)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM vo GROUP BY source),
g AS (SELECT source, label, off + local_id AS gid FROM l JOIN o USING (source)), t AS (SELECT lower(label) AS target, row_number() OVER (ORDER BY lower(label)) AS tid FROM (SELECT DISTINCT label FROM vo WHERE length(label) % 2 = 0))
SELECT 'global_id2source' AS part, cast(gid AS BIGINT)::VARCHAR AS key, source || ':' || label AS value FROM g UNION ALL SELECT 'target_id2label', tid::VARCHAR, target FROM t
UNION ALL SELECT 'dataset_offsets', source, cast(off AS BIGINT)::VARCHAR FROM o UNION ALL SELECT 'source_to_target', cast(gid AS BIGINT)::VARCHAR, coalesce(tid, 0)::VARCHAR FROM g LEFT JOIN t ON target = lower(label)
UNION ALL SELECT 'concept_id2name', n_nationkey::VARCHAR, n_name FROM nation UNION ALL SELECT 'params', 'num_target_classes', (SELECT count(*) FROM t)::VARCHAR UNION ALL SELECT 'params', 'num_global_source_classes', (SELECT count(*) FROM g)::VARCHAR""")
def registry_dump(spark, sf_dir):
    v, path = Views(spark, sf_dir), _folder(spark)
    vocab = R.vocabulary(v.part.withColumn("src", F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string"))), "src", "p_type")
    ids = R.global_ids(vocab)
    pairs = v.part.where(F.length("p_type") % 2 == 0).select(F.col("p_type").alias("label"), F.col("p_type").alias("target")).distinct()
    targets = R.target_ids(pairs)
    offsets = R.offsets(vocab.groupBy("source").agg(F.count(F.lit(1)).alias("size")), "source", "size")
    concepts = v.nation.select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("name"))
    sinks.dump_registry(path, ids, targets, offsets, R.source_to_target(ids, pairs, targets), concepts)
    names = ("global_id2source", "target_id2label", "dataset_offsets", "source_to_target", "concept_id2name")
    out = spark.read.schema("num_target_classes string, num_global_source_classes string").json(f"{path}/params")
    out = out.unpivot([], out.columns, "key", "value").select(F.lit("params").alias("part"), "key", "value")
    for n in names:
        out = out.unionByName(spark.read.schema("key string, value string").json(f"{path}/{n}").withColumn("part", F.lit(n)))
    return out


@query("""SELECT * FROM (VALUES ('pull and push', 'a', 'b'), ('push alone', 'b', 'b'), ('pull alone', 'a', NULL)) t("given", "pull", push)""")
def checkpoint_places(spark, sf_dir):
    cases = {"pull and push": ("a", "b"), "push alone": (None, "b"), "pull alone": ("a", None)}
    return spark.createDataFrame([(k, *sinks.checkpoint_paths(*x)) for k, x in cases.items()], "given string, pull string, push string")


@query("""SELECT * FROM (VALUES ('explicit tag', 'v7'), ('computed day', '20260102'), ('explicit input', 'p/x.parquet'), ('legacy input', 'old/annotations.parquet')) t("case", value)""")
def versions(spark, sf_dir):
    unset = f"UNSET_{uuid.uuid4().hex}"
    rows = [
        ("explicit tag", sinks.version_tag("v7", unset)), ("computed day", sinks.version_tag(None, unset, dt.date(2026, 1, 2)).split("_")[0]),
        ("explicit input", sinks.resolve_input("p/x.parquet", unset, "e/{}/annotations.parquet", "old/annotations.parquet")),
        ("legacy input", sinks.resolve_input(None, unset, "e/{}/annotations.parquet", "old/annotations.parquet")),
    ]
    return spark.createDataFrame(rows, "case string, value string")


_JPEG = "CASE WHEN k % 11 = 0 THEN 'corrupt' WHEN k % 13 = 0 THEN 'not_found' WHEN k % 17 = 0 THEN 's3_error' WHEN k % 19 = 0 THEN 'sof_not_found_extended' ELSE 'ok' END"


@query(f"""WITH i AS (SELECT o_orderkey AS k, cast(400 + (o_orderkey * 37) % 4000 AS INTEGER) AS w, cast(300 + (o_orderkey * 53) % 3000 AS INTEGER) AS h FROM orders),
s AS (SELECT *, {_JPEG} AS st FROM i), d AS (SELECT *, st IN ('ok', 'sof_not_found_extended') AS good FROM s)
SELECT cast(k % 50 AS INTEGER) AS source_id, k::VARCHAR AS image_id, 'raw/' || k AS s3_key, CASE WHEN good THEN w END AS width, CASE WHEN good THEN h END AS height,
CASE WHEN good THEN greatest(w, h) END AS longest_edge, k AS file_size, good AND greatest(w, h) > 2048 AS needs_resize, st AS header_status, CASE WHEN NOT good THEN CASE st WHEN 's3_error' THEN 'denied' ELSE st END END AS error_message FROM d""")
def image_headers(spark, sf_dir):
    """JPEG bytes made of sizes; some have their header beyond the first chunk, some are broken, missing or could not be read."""
    k = F.col("o_orderkey")
    w, h = (400 + (k * 37) % 4000).cast("int"), (300 + (k * 53) % 3000).cast("int")
    two = lambda c: F.lpad(F.hex(c), 4, "0")
    frame = F.concat(F.lit("FFC0001108"), two(h), two(w), F.lit("03" * 10))
    segment = F.concat(F.lit("FFE0EA62"), F.repeat(F.lit("00"), 60000))
    far = (k % 11 != 0) & (k % 13 != 0) & (k % 17 != 0) & (k % 19 == 0)
    body = F.when(k % 11 == 0, F.lit("4E4F")).when(far, F.concat(F.lit("FFD8"), segment, segment, frame)).otherwise(F.concat(F.lit("FFD8"), frame))
    error = F.when((k % 11 != 0) & (k % 13 != 0) & (k % 17 == 0), "denied")
    rows = Views(spark, sf_dir).orders.select(
        (k % 50).cast("int").alias("source_id"), k.cast("string").alias("image_id"), F.concat(F.lit("raw/"), k.cast("string")).alias("s3_key"),
        F.when((k % 11 == 0) | (k % 13 != 0), F.unhex(body)).alias("content"), k.alias("length"), error.alias("error"),
    )
    # a missing or unread file tells its reason in the same columns
    return schemas.conform(I.scan_images(rows), schemas.IMAGES)


@query("SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN page_id * 7 END AS total FROM pages")
def content_range(spark, sf_dir):
    k = F.col("page_id")
    header = F.when(k % 3 != 0, F.concat(F.lit("bytes 0-65535/"), (k * 7).cast("string"))).otherwise("bytes 0-1/*")
    return Views(spark, sf_dir).pages.select("page_id", I.content_range_total(header).alias("total"))


@query("SELECT p_partkey, cast(least(greatest(floor((p_partkey % 500 - 20) * (1000 + p_size) / 400), 0), 999 + p_size) AS INTEGER) AS x FROM part")
def source_coordinates(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    return Views(spark, sf_dir).part.select("p_partkey", I.source_coordinate(k % 500 - 20, F.lit(400), 1000 + size).alias("x"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN 'background' WHEN l_linenumber % 4 IN (1, 2) THEN 'unclassified' ELSE 'target' END AS kind FROM lineitem""")
def label_kinds(spark, sf_dir):
    n = F.col("l_linenumber") % 4
    name = F.when(n == 1, " Other").when(n == 2, "UNKNOWN ").otherwise("coral")
    return Views(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", T.label_kind(n, name).alias("kind"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CASE o_orderkey % 3 WHEN 1 THEN 'e' ELSE 'e,e' END END AS errors FROM orders")
def empty_list_is_null(spark, sf_dir):
    errors = F.array_repeat(F.lit("e"), (F.col("o_orderkey") % 3).cast("int"))
    return Views(spark, sf_dir).orders.select("o_orderkey", F.array_join(T.null_if_empty(errors), ",").alias("errors"))


@query(f"""WITH {IMG} SELECT cast(l_orderkey % 50 AS INTEGER) AS source_id, cast(l_orderkey AS VARCHAR) AS image_id, l_linenumber,
CASE WHEN l_orderkey % 4 = 0 THEN 'data/s' || l_orderkey % 50 || '/images/' || l_orderkey || '.jpg' ELSE 'a/' || l_orderkey END AS s3_key FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
def source_keys(spark, sf_dir):
    """The least of the keys that an image is stored under, else the template's; an image listed twice doubles nothing."""
    v = Views(spark, sf_dir)
    k = F.col("o_orderkey")
    one = lambda p: v.orders.select((k % 50).cast("int").alias("source_id"), k.cast("string").alias("image_id"), F.when(k % 4 != 0, F.concat(F.lit(p), k.cast("string"))).alias("s3_key"))
    items = v.lineitem.select((F.col("l_orderkey") % 50).cast("int").alias("source_id"), F.col("l_orderkey").cast("string").alias("image_id"), "l_linenumber")
    return Q.with_source_key(items, one("b/").union(one("a/"))).select("source_id", "image_id", "l_linenumber", "s3_key")


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL AND quality <> toxic")
def both_given_and_different(spark, sf_dir):
    return Views(spark, sf_dir).labels.select("doc_id", "quality", "toxic").where("quality is not null and toxic is not null and quality != toxic")


@query("SELECT o_orderkey, count(l_linenumber) AS loaded FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber % 5 <> 0 GROUP BY 1")
def failed_items_dropped(spark, sf_dir):
    """Batches without their failed (null) items; a batch of which all failed stays, empty."""
    v = Views(spark, sf_dir)
    items = v.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_linenumber")).alias("item"))
    batch = v.orders.select("o_orderkey").join(items, "o_orderkey", "left").groupBy("o_orderkey").agg(F.collect_list("item").alias("items"))
    return batch.select("o_orderkey", F.size("items").cast("bigint").alias("loaded"))


@query("""SELECT * FROM (VALUES ('nation', 'n_name'), ('nation', 'n_nationkey'), ('nation', 'n_regionkey'), ('region', 'r_name'), ('region', 'r_regionkey')) t("label", "column")""")
def schema_inventory(spark, sf_dir):
    v = Views(spark, sf_dir)
    rows = [(t, c) for t in ("nation", "region") for c in getattr(v, t).columns]
    return spark.createDataFrame(rows, "label string, column string")


@query("""SELECT 'orders' AS part, cast(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 'missing columns', 1 UNION ALL SELECT 'null required', count(*) FILTER (WHERE o_orderkey % 97 = 0) FROM orders UNION ALL SELECT 'repeated keys', 0""")
def schema_checks(spark, sf_dir):
    """Conforming rows, a table that lacks columns, and nulls and repeated keys counted."""
    v = Views(spark, sf_dir)
    rows = v.img.withColumns({"longest_edge": F.greatest("width", "height"), "file_size": F.lit(None), "header_status": F.when(F.col("width").isNotNull(), "ok"), "error_message": F.lit(None)})
    good = schemas.conform(rows, schemas.IMAGES)
    try:
        schemas.validate(v.orders, schemas.IMAGES)
        refused = 0
    except schemas.SchemaError:
        refused = 1
    name = lambda df, x: df.select(F.lit(x).alias("part"), F.col("n").cast("bigint").alias("n"))
    nulls = schemas.required_nulls(good, schemas.IMAGES)
    out = name(good.agg(F.count(F.lit(1)).alias("n")), "orders").union(name(spark.range(1).withColumn("n", F.lit(refused)), "missing columns"))
    out = out.union(name(nulls.withColumnRenamed("header_status", "n"), "null required"))
    return out.union(name(schemas.duplicate_keys(good, list(schemas.KEYS["images"])).agg(F.count(F.lit(1)).alias("n")), "repeated keys"))


@query("SELECT split_part(url, '://', 1) AS scheme, count(*) AS n FROM (SELECT url FROM pages ORDER BY md5('3:' || page_id), page_id LIMIT 150) GROUP BY 1")
def sampled_modes(spark, sf_dir):
    """Forms of an attribute on a seeded sample of exact size, by falling count."""
    sample = seeded_sample(Views(spark, sf_dir).pages.select("page_id", "url"), F.col("page_id"), 150, seed=3)
    return S.value_counts(sample.select(F.split_part("url", F.lit("://"), F.lit(1)).alias("scheme")), "scheme")


@query("SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 300")
def mixed_sort(spark, sf_dir):
    """The first rows by a rising, then a falling key, with the id against ties."""
    return Views(spark, sf_dir).customer.select("c_mktsegment", "c_acctbal", "c_custkey").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey").limit(300)
