"""Joins of the vector search do not send what grows with the vectors through the driver."""

import pytest
from pyspark.sql import functions as F

from weftline.llm import itq

WIDTH, PART, TABLES = 8, 16, 6


@pytest.fixture(scope="module")
def codes(spark, tmp_path_factory):
    """A stored table of codes, so small that Spark broadcasts it where it may."""
    path = str(tmp_path_factory.mktemp("codes") / "codes")
    row = [F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), F.lit(1).cast("bigint").alias("within")]
    row += [F.xxhash64(F.lit(i), F.floor(F.col("id") / 2)).alias(f"c{i}") for i in range(2)]
    spark.range(40).select(*row, F.array(*[F.rand(i) for i in range(WIDTH)]).alias("v")).write.parquet(path)
    return spark.read.parquet(path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_probes_are_not_broadcast(codes):
    pairs = itq._candidates(codes.drop("v"), PART, TABLES, 2, 20)
    assert "Broadcast" not in _plan(pairs)
    assert pairs.count() == 20  # each pair of equal codes, once


def test_pairs_are_not_broadcast(codes):
    pairs = itq._candidates(codes.drop("v"), PART, TABLES, 2, 20)
    assert "Broadcast" not in _plan(itq._linked(pairs, codes, WIDTH, -1.0))
