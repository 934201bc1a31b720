"""Pairs that are left after the rounds of leaders: few are looked at where links abound, and none is lost."""

import pytest
from pyspark.sql import functions as F

from weftline.llm.graph import ROUNDS, link_buckets

SIZE = 300


def _linked(spark, link):
    """Components of two groups of ``SIZE`` ids in one bucket, linked within by ``link``; and how many pairs were looked at."""
    buckets = spark.range(2 * SIZE).select(F.lit(1).cast("bigint").alias("bucket"), "id")
    seen = []

    def verify(pairs):
        seen.append(pairs.count())
        return pairs.where(link)

    found = link_buckets(buckets, verify, lambda: F.lit(True)).collect()
    return {r.id: r.component for r in found}, sum(seen)


def test_groups_that_many_pairs_link_are_one_after_few(spark):
    """One pair in twenty between two groups is a link, but those that lead the rounds link within their group alone."""
    within = f"(a < {SIZE}) = (b < {SIZE})"
    ids = spark.range(2 * SIZE)
    lead = [2 * SIZE - 1, *(ids.orderBy(F.xxhash64(F.lit(turn), "id").desc()).first().id for turn in range(1, ROUNDS))]
    leads = ", ".join(map(str, lead))
    component, seen = _linked(spark, f"{within} or (a not in ({leads}) and b not in ({leads}) and pmod(xxhash64(a, b, 5L), 20) = 0)")
    assert set(component) == set(range(2 * SIZE)) and len(set(component.values())) == 1
    assert seen < SIZE * SIZE / 4


@pytest.mark.parametrize(("a", "b"), [(3, 2 * SIZE - 5), (17, SIZE + 1), (SIZE - 1, SIZE)])
def test_a_single_link_is_found_in_whatever_share(spark, a, b):
    within = f"(a < {SIZE}) = (b < {SIZE})"
    component, _ = _linked(spark, f"{within} or (a = {a} and b = {b})")
    assert len(component) == 2 * SIZE and len(set(component.values())) == 1
