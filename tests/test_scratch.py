"""Tables in the scratch folder: what they tell of their rows, and memory of the driver."""

from pyspark.sql import functions as F

from weftline.plans import scratch


def test_stored_tables_tell_their_rows(spark):
    some = scratch.stored(spark.range(10).where("id > 3"), "some", large=F.count_if(F.col("id") > 7))
    none = scratch.stored(spark.range(10).where("id > 30").groupBy("id").count(), "none")
    assert (some.n_rows, some.counted["large"], none.n_rows) == (6, 2, 0)


def test_native_memory_is_given_back(spark):
    """Some JDKs cannot: then nothing happens."""
    scratch._give_back(spark)
    assert spark.range(3).count() == 3
