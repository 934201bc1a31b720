"""Queries of the training-data operators, and the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.plans.tables import table

from . import bagminhash, chatformat, decontaminate, hilbert, itq, linededup, packing, resample, toxicity, urlrules

SHARDS = 40
#: (host, path, verdict)
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_gated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = hilbert.shard_rows(table(spark, sf_dir, "documents"), SHARDS)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op3_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urlrules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.range(2).select(
            F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
        )
    )
    # the log: each row is a message of its own, also where rows share a turn. Answers are streamed in
    # deltas after an attempt that is regenerated, and other texts are edited into what they are
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    half = F.length("text") / 2
    event = lambda nth, kind, role, text: F.struct(F.lit(nth).alias("nth"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    head, tail = F.substr("text", F.lit(1), F.floor(half).cast("int")), F.substr("text", (F.floor(half) + 1).cast("int"))
    streamed = F.array(
        event(0, "message", F.col("role"), F.lit("")), event(1, "delta", none, F.lit("a first attempt")), event(2, "regenerate", none, none),
        event(3, "delta", none, head), event(4, "delta", none, tail),
    )
    edited = F.array(event(0, "message", F.col("role"), F.lit("a draft")), event(1, "edit", none, F.col("text")))
    events = rows.withColumn("message", place).withColumn("event", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)))
    log = events.select("conv_id", (F.col("message") * 8 + F.col("event.nth")).alias("seq"), "message", "event.kind", "event.role", "event.text")
    rendered = chatformat.render(chatformat.fold_events(log))
    back = chatformat.read_back(rendered)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = linededup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select(
        "doc_id", "text", F.col("_weftline_lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_weftline_gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.col("_weftline_gone").alias("removed"),
    )


def op9_gumbel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_itq_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.similar_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_gated_toxicity, op2_hilbert_shards, op3_wu_manber, op4_bagminhash, op5_url_sweep, op6_chat_events, op7_lexical_packing, op8_fuzzy_lines, op9_gumbel_quality, op10_itq_vectors)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op3_wu_manber": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS m,
        list_slice(w, i, i + least(13, len(w)) - 1) AS p
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
hits AS (SELECT DISTINCT r, i, bw.m, item_id FROM
        (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0) x
        JOIN (SELECT DISTINCT m FROM bw) ms ON i + ms.m - 1 <= len(w)
        JOIN bw ON bw.m = ms.m AND bw.p = list_slice(w, i, i + ms.m - 1)),
n AS (SELECT r, count(DISTINCT pos) AS n_hit FROM
        (SELECT r, unnest(generate_series(i, i + m - 1)) AS pos FROM hits) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM
        (SELECT DISTINCT r, cast(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    cast(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)""",
    "op5_url_sweep": r"""
WITH p AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
j AS (SELECT p.*, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC NULLS LAST) AS k
    FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE k = 1""",
    "op10_itq_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
    AND list_cosine_similarity(x.e, y.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, cast(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op6_chat_events": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, cast(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    cast(sum(12 + 1 + 11 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&NewLine;'))
        + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
}
