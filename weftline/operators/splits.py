"""Splits of sources: exact seeded samples, batches, checks, and a balanced assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_sample(rows: DataFrame, key: Column, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all), the least by a hash of seed and key, whatever the partitioning."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), key).limit(n)


def batches(rows: DataFrame, size: int) -> DataFrame:
    """Half-open ranges [start, end) of at most ``size`` positions that cover the rows."""
    n = rows.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    starts = n.select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(size).cast("bigint"))).alias("start"))
    return starts.select("start", F.least(F.col("start") + size, F.col("n")).alias("end"))


def round_robin(rows: DataFrame, order: str, shards: int) -> DataFrame:
    """Shard of each row of a dimension table, dealt in turn by ``order``."""
    return rows.withColumn("shard", (F.row_number().over(Window.orderBy(order)) - 1) % shards)


def rare_labels(counts: DataFrame, label: str, source: str, least: int = 3) -> DataFrame:
    """Labels in fewer than ``least`` sources, which no three-way split can hold everywhere."""
    return counts.groupBy(label).agg(F.count_distinct(source).alias("n_sources")).where(F.col("n_sources") < least)


def shared_sources(rows: DataFrame, source: str, split: str) -> DataFrame:
    return rows.groupBy(source).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def label_balance(rows: DataFrame, label: str, split: str, splits: Sequence[str]) -> DataFrame:
    """Per label: its share of each split and of all, the largest deviation, coverage, and the spread of the ratios."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(split) == s).alias(s) for s in splits])
    everything = Window.partitionBy(F.lit(1))
    share = {s: F.col(s) / F.nullif(F.sum(s).over(everything), F.lit(0)) for s in splits}
    out = counts.withColumns({"share": F.col("n") / F.sum("n").over(everything)} | {f"{s}_share": v for s, v in share.items()})
    shares = [F.coalesce(f"{s}_share", F.lit(0.0)) for s in splits]
    ratios = F.array(*[x / F.col("share") for x in shares])
    mean = F.aggregate(ratios, F.lit(0.0), lambda a, x: a + x) / len(splits)
    var = F.aggregate(ratios, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (len(splits) - 1)
    present = sum(((F.col(s) > 0).cast("int") for s in splits), F.lit(0))
    return out.select(
        label, "share", *[f"{s}_share" for s in splits], F.greatest(*[F.abs(x - F.col("share")) for x in shares]).alias("max_deviation"),
        present.alias("n_splits"), F.sqrt(var).alias("ratio_std"),
    )


def split_of_source(rows: DataFrame, source: str, split: str) -> DataFrame:
    """The one split of each source with its row count."""
    return rows.groupBy(source).agg(F.min(split).alias("split"), F.count(F.lit(1)).alias("n"))


def balanced_split(
    counts: DataFrame, source: str, label: str, n: str, shares: dict[str, float], trials: int = 200, seed: int = 0, slack: float = 0.2
) -> DataFrame:
    """Assign whole sources to splits so that every label's share comes near ``shares``.

    ``counts`` has one row per source and label, a small matrix that goes to
    every trial. A trial shuffles the sources and gives each to the split with
    the greatest unmet need that it does not overfill by more than ``slack``;
    trials are rows, tried in parallel, and the least chi-square plus size
    penalty wins, ties by trial number. A label in fewer than three sources is
    an error. Random streams are numpy's, seeded per trial.
    """
    import numpy as np

    rare = [r[0] for r in rare_labels(counts, label, source).orderBy(label).collect()]
    if rare:
        raise ValueError(f"labels in fewer than three sources: {rare[:10]}")
    cells = counts.groupBy(source, label).agg(F.sum(n).alias("n")).orderBy(source, label).collect()
    sources = sorted({r[0] for r in cells})
    labels = sorted({r[1] for r in cells})
    matrix = np.zeros((len(sources), len(labels)))
    at, of = {s: i for i, s in enumerate(sources)}, {x: i for i, x in enumerate(labels)}
    for r in cells:
        matrix[at[r[0]], of[r[1]]] = r.n
    names, part = list(shares), np.array(list(shares.values()))
    spark = counts.sparkSession
    kept = spark.sparkContext.broadcast(matrix)

    def attempt(frames):
        import numpy as np
        import pandas as pd

        m = kept.value
        want = part[:, None] * m.sum(axis=0)
        room = part * m.sum() * (1 + slack)
        for frame in frames:
            rows = []
            for trial in frame["trial"]:
                rng = np.random.default_rng([seed, trial])
                got, chosen = np.zeros_like(want), np.zeros(len(m), dtype=int)
                for s in rng.permutation(len(m)):
                    need = ((want - got) / np.maximum(want, 1) * m[s]).sum(axis=1)
                    full = got.sum(axis=1) + m[s].sum() > room
                    chosen[s] = np.argmax(np.where(full & ~full.all(), -np.inf, need))
                    got[chosen[s]] += m[s]
                chi = ((got - want) ** 2 / np.maximum(want, 1)).sum()
                size = np.abs(got.sum(axis=1) / m.sum() - part).sum() * m.sum()
                missing = (got == 0).sum() * m.sum()
                rows.append((trial, float(chi + size + missing), chosen.tolist()))
            yield pd.DataFrame(rows, columns=["trial", "score", "chosen"])

    tried = spark.range(trials).withColumnRenamed("id", "trial").repartition(8).mapInPandas(attempt, "trial bigint, score double, chosen array<bigint>")
    best = tried.agg(F.min_by("chosen", F.struct("score", "trial")).alias("chosen"), F.min("score").alias("score"))
    place = best.select("score", F.posexplode("chosen").alias("place", "choice"))
    keys = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], ["place", source])
    return place.join(keys, "place").select(source, F.element_at(F.array(*map(F.lit, names)), (F.col("choice") + 1).cast("int")).alias("split"))
