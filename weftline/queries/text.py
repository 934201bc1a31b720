from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions import text as T

from .base import Views, query


@query("""SELECT page_id, nullif(regexp_extract('/image/' || regexp_extract(url, '/([0-9]+)', 1) || '/view/', '/image/(\\d+)/?', 1), '') AS image_id FROM pages""")
def url_id_extract(spark, sf_dir):
    url = F.concat(F.lit("/image/"), F.regexp_extract("url", r"/([0-9]+)", 1), F.lit("/view/"))
    return Views(spark, sf_dir).pages.select("page_id", T.url_image_id(url).alias("image_id"))


_NAME = """'img_' || page_id || '.jpg' || CASE page_id % 4 WHEN 0 THEN ' - Confirmed' WHEN 1 THEN ' - Unconfirmed' WHEN 2 THEN ' - Unclassified' ELSE '' END"""


@query(f"""WITH n AS (SELECT page_id, {_NAME} AS name FROM pages) SELECT page_id, regexp_extract(name, '^(.*?)(?: - (Confirmed|Unconfirmed|Unclassified))?$', 1) AS stripped,
nullif(regexp_extract(name, '^(.*?)(?: - (Confirmed|Unconfirmed|Unclassified))?$', 2), '') AS status FROM n""")
def name_status_split(spark, sf_dir):
    k = F.col("page_id") % 4
    tail = F.when(k == 0, " - Confirmed").when(k == 1, " - Unconfirmed").when(k == 2, " - Unclassified").otherwise("")
    name = F.concat(F.lit("img_"), F.col("page_id").cast("string"), F.lit(".jpg"), tail)
    return Views(spark, sf_dir).pages.select("page_id", T.name_without_status(name).alias("stripped"), T.status_in_name(name).alias("status"))


@query("""SELECT DISTINCT page_id, a AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"/]+)"', 1)) AS a FROM pages)""")
def anchor_extract(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit('<a href="/([^"/]+)"'), F.lit(1))
    return Views(spark, sf_dir).pages.select("page_id", F.explode(found).alias("target")).distinct()


@query("""SELECT page_id, CASE WHEN contains(h, 'Page could not be found') THEN 'Source does not exist' WHEN contains(h, 'don''t have permission') THEN 'Permission denied' END AS error
FROM (SELECT page_id, html || CASE page_id % 5 WHEN 0 THEN 'Page could not be found' WHEN 1 THEN 'You don''t have permission' ELSE '' END AS h FROM pages)""")
def access_flag(spark, sf_dir):
    k = F.col("page_id") % 5
    page = F.concat("html", F.when(k == 0, "Page could not be found").when(k == 1, "You don't have permission").otherwise(""))
    return Views(spark, sf_dir).pages.select("page_id", H.access_error(page).alias("error"))


@query("""SELECT page_id, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title FROM pages""")
def title_extract(spark, sf_dir):
    return Views(spark, sf_dir).pages.select("page_id", H.title(F.col("html")).alias("title"))


def _status_page():
    row = lambda name, n: F.concat(F.lit(f"<tr><td>{name}</td><td><a href='#'>"), n, F.lit("</a></td></tr>"))
    k = F.col("o_orderkey")
    return F.concat(
        F.lit('<h4>Image Status</h4>\n<table class="detail_box_table">'), row("Unclassified:", (k % 7).cast("string")),
        row("Unconfirmed:", (k % 11).cast("string")), row("Confirmed:", F.format_number(k * 3, 0)),
        F.when(k % 4 != 0, row("Total images:", F.format_number(k * 5, 0))).otherwise(""),
        F.lit('</table><form id="export-annotations-prep-form"><input type="hidden" name="csrfmiddlewaretoken" value="t'), k.cast("string"), F.lit('"></form>'),
        F.lit("<script>// Classifier overview\nlet classifierPlotData = [{'x': "), k.cast("string"), F.lit(", 'y': "), (k % 9).cast("string"), F.lit("}];</script>"),
    )


@query("""SELECT o_orderkey, cast(o_orderkey % 7 AS INTEGER) AS unclassified, cast(o_orderkey % 11 AS INTEGER) AS unconfirmed, cast(o_orderkey * 3 AS INTEGER) AS confirmed,
cast(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey * 5 ELSE 0 END AS INTEGER) AS total_images FROM orders""")
def status_table_parse(spark, sf_dir):
    rows = Views(spark, sf_dir).orders.select("o_orderkey", _status_page().alias("page"))
    page = F.col("page")
    fields = [H.status_count(page, f).alias(f) for f in ("unclassified", "unconfirmed", "confirmed")]
    return rows.select("o_orderkey", *fields, H.total_images(page).alias("total_images"))


@query("SELECT o_orderkey, 't' || o_orderkey AS token, 't' || o_orderkey AS form_token FROM orders")
def token_extract(spark, sf_dir):
    rows = Views(spark, sf_dir).orders.select("o_orderkey", _status_page().alias("page"))
    return rows.select("o_orderkey", H.hidden_token(F.col("page")).alias("token"), H.form_token(F.col("page")).alias("form_token"))


@query("SELECT o_orderkey, o_orderkey AS x, o_orderkey % 9 AS y FROM orders")
def js_array_rows(spark, sf_dir):
    rows = Views(spark, sf_dir).orders.select("o_orderkey", _status_page().alias("page"))
    return rows.select("o_orderkey", F.inline(H.script_rows(F.col("page"), "x: bigint, y: bigint")))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_props_extract(spark, sf_dir):
    return Views(spark, sf_dir).events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE cast(trunc(event_id / 2.0::DOUBLE) AS INTEGER) END AS n FROM events""")
def coercing_cast(spark, sf_dir):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "n/a").when(k == 1, "nan").otherwise((F.col("event_id") / 2).cast("string"))
    return Views(spark, sf_dir).events.select("event_id", T.coerced_int(raw).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, cast(round_even(x, 0) AS INTEGER) AS n FROM (SELECT l_orderkey, l_linenumber, l_quantity / 2 AS x FROM lineitem)""")
def half_even_round(spark, sf_dir):
    return Views(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", T.half_even_int(F.col("l_quantity") / 2).alias("n"))


@query("""SELECT page_id, 'data/s' || page_id % 9 || '/images/' || page_id || '.jpg' AS image_key, 'data/resized/s' || page_id % 9 || '/images/' || page_id || '.jpg' AS resized_key FROM pages""")
def key_templates(spark, sf_dir):
    s, i = F.col("page_id") % 9, F.col("page_id")
    return Views(spark, sf_dir).pages.select("page_id", T.image_key("data", s, i).alias("image_key"), T.resized_key("data", s, i).alias("resized_key"))


@query(r"""WITH p AS (SELECT page_id, 'data/s' || page_id % 9 || '/images/a.' || page_id || CASE WHEN page_id % 3 = 0 THEN '' ELSE '.jpg' END AS path FROM pages)
SELECT page_id, split_part(path, '/', -1) AS name, regexp_replace(split_part(path, '/', -1), '^(.+)\.[^.]*$', '\1') AS stem,
regexp_extract(split_part(path, '/', -1), '^.+(\.[^.]+)$', 1) AS suffix, 'data/s' || page_id % 9 || '/images' AS parent FROM p""")
def path_parts(spark, sf_dir):
    tail = F.when(F.col("page_id") % 3 == 0, "").otherwise(".jpg")
    path = F.concat(F.lit("data/s"), (F.col("page_id") % 9).cast("string"), F.lit("/images/a."), F.col("page_id").cast("string"), tail)
    rows = Views(spark, sf_dir).pages.select("page_id", path.alias("path"))
    p = F.col("path")
    return rows.select("page_id", T.file_name(p).alias("name"), T.file_stem(p).alias("stem"), T.file_suffix(p).alias("suffix"), T.parent_path(p).alias("parent"))


@query("""SELECT p_partkey, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS label, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS brand FROM part""")
def normalise_labels(spark, sf_dir):
    k = F.col("p_partkey") % 3
    brand = F.when(k == 0, F.when(F.col("p_partkey") % 2 == 0, "None").otherwise("nan")).otherwise(F.col("p_brand"))
    return Views(spark, sf_dir).part.select("p_partkey", T.capitalized(F.col("p_type")).alias("label"), T.sentinel_to_null(brand).alias("brand"))


@query("""SELECT p_partkey, split_part(c, '__', 1) AS rank, substr(c, length(split_part(c, '__', 1)) + 3) AS value FROM (SELECT p_partkey, 'genus__' || p_brand || '__x' AS c FROM part)
WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, NULL, p_brand FROM part WHERE p_partkey % 2 <> 0""")
def rank_split(spark, sf_dir):
    c = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("genus__"), "p_brand", F.lit("__x"))).otherwise(F.col("p_brand"))
    rank, value = T.rank_and_value(c)
    return Views(spark, sf_dir).part.select("p_partkey", rank.alias("rank"), value.alias("value"))
