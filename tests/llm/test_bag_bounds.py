"""The bound of two bags is never below their overlap, and shows most pairs that lie apart."""

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import bagminhash


def test_tables_bound_the_overlap(spark):
    rng = np.random.default_rng(5)
    texts, own = [], []
    for kept in (0, 30, 60, 75, 85, 95, 100):
        for _ in range(10):
            a = [f"w{x}" for x in rng.integers(0, 10**6, 100)]
            texts.append((" ".join(a), " ".join(a[:kept] + [f"v{x}" for x in rng.integers(0, 10**6, 100 - kept)])))
    rows = []
    for a, b in texts:
        bags = [np.unique(bagminhash.shingles(t.encode()), return_counts=True) for t in (a, b)]
        own.append(bagminhash.overlap(*bags))
        rows.append([len(rows), *(v for h, c in bags for v in (int(c.sum()), int(c.sum()), *bagminhash.table_of(h).tolist()))])
    names = ["i", *(f"{x}_{c}" for x in "ab" for c in ("size", "common", *(f"t{i}" for i in range(bagminhash.TABLE))))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in names))
    left = {r.i for r in df.where(bagminhash._bounded(0.8)).select("i").collect()}
    assert left >= {i for i, x in enumerate(own) if x >= 0.8}
    assert not left & {i for i, x in enumerate(own) if x < 0.7}
    assert 0 < len(left) < len(rows)
