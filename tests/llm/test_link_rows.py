"""What the rounds of links cost in rows of joins by id."""

from pyspark.sql import functions as F

from weftline.llm import graph


def test_no_inner_join_has_a_row_for_each_bucket_of_an_id(spark, monkeypatch):
    """Ids that share 20 buckets and link with nothing: joins by id come to a row for each id, however many buckets it has."""
    buckets = spark.range(12).select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(20).cast("bigint"))).alias("bucket"), "id")
    kept, store = {}, graph.stored

    def seen(df, name, **counted):
        out = store(df, name, **counted)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        kept.setdefault(name, []).append((out.n_rows, plan))
        return out

    monkeypatch.setattr(graph, "stored", seen)
    found = graph.link_buckets(buckets, lambda pairs: pairs.where("false"), lambda: F.lit(True), lambda ids: ids.withColumn("trait", F.col("id")))
    assert found.count() == 0
    assert [n for n, _ in kept["open"]] == [12, 12] and kept["traits"][0][0] == 12
    by_id = [name for name, plans in kept.items() for n, plan in plans if "Join Inner, (id#" in plan and n > 12]
    assert not by_id
