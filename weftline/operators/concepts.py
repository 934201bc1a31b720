"""Concept channels of labels: taxonomic ranks, binary traits, encodings and their inverses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import rank_and_value

ABSENT = "not_given"


def taxonomy_ids(rows: DataFrame, rank: str) -> DataFrame:
    """Ids of a rank's values: not_given is 0, the others 1..n by name."""
    values = rows.select(F.col(rank).alias("value")).where(F.col("value").isNotNull() & (F.col("value") != ABSENT)).distinct()
    numbered = values.withColumn("id", F.row_number().over(Window.orderBy("value")))
    none = rows.sparkSession.range(1).select(F.lit(ABSENT).alias("value"), F.lit(0).alias("id"))
    return none.unionByName(numbered)


def rank_values(rows: DataFrame, rank: str) -> list[str]:
    """A rank's concrete values in order; a dimension's worth, on the driver."""
    found = rows.select(rank).where(F.col(rank).isNotNull() & (F.col(rank) != ABSENT)).distinct().orderBy(rank)
    return [r[0] for r in found.collect()]


def binary_vector(value: Column, values: Sequence[str]) -> Column:
    """2 in the value's own channel and 1 in the others; zeros for not_given, null or unknown."""
    known = value.isin(*values) if values else F.lit(False)
    own = [F.when(~F.coalesce(known, F.lit(False)), 0).when(value == v, 2).otherwise(1) for v in values]
    return F.array(*own) if own else F.array().cast("array<int>")


def truth(c: Column) -> Column:
    """TRUE and FALSE in any case, and booleans, as booleans; all else null."""
    text = F.upper(c.cast("string"))
    return F.when(text == "TRUE", True).when(text == "FALSE", False)


def meaningful_traits(rows: DataFrame, traits: Sequence[str]) -> list[str]:
    """The traits that hold for some row and fail for some row; one pass."""
    if not traits:
        return []
    seen = rows.agg(*[F.coalesce(F.bool_or(truth(F.col(t))) & F.bool_or(~truth(F.col(t))), F.lit(False)).alias(t) for t in traits]).first()
    return [t for t in traits if seen[t]]


def binary_trait(c: Column) -> Column:
    """2 for true, 1 for false, 0 for not given."""
    return F.when(truth(c), 2).when(~truth(c), 1).otherwise(0)


def channel_names(rows: DataFrame, ranks: Sequence[str], traits: Sequence[str]) -> list[str]:
    return [f"{r}__{v}" for r in ranks for v in rank_values(rows, r)] + meaningful_traits(rows, traits)


def encode_channels(rows: DataFrame, ranks: Sequence[str], traits: Sequence[str], schema_rows: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``channels``: the vectors of all ranks in order, then the meaningful traits."""
    of = rows if schema_rows is None else schema_rows
    parts = [binary_vector(F.col(r), rank_values(of, r)) for r in ranks]
    parts += [F.array(binary_trait(F.col(t))) for t in meaningful_traits(of, traits)]
    return rows.withColumn("channels", F.concat(*parts) if parts else F.array().cast("array<int>"))


def concept_matrix(labels: DataFrame, encoded: DataFrame, width: int) -> DataFrame:
    """Channels of global ids 0..N: zeros for 0 and for labels without a row.

    ``labels`` has global_id and label; of several encoded rows of a label, the
    one with the highest ``position`` counts.
    """
    last = encoded.groupBy("label").agg(F.max_by("channels", "position").alias("channels"))
    zero = labels.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("global_id"), F.lit(None).cast("string").alias("label"))
    every = labels.select(F.col("global_id").cast("bigint").alias("global_id"), "label").unionByName(zero)
    return every.join(last, "label", "left").select("global_id", F.coalesce("channels", F.array_repeat(F.lit(0), width)).alias("channels"))


def with_concepts(concepts: DataFrame, labels: DataFrame) -> DataFrame:
    """Every label of the registry with its concept row, matched by lower-cased name and source."""
    right = labels.select("global_id", F.lower("label").alias("_l"), F.lower("source").alias("_s"))
    left = concepts.withColumns({"_l": F.lower("label"), "_s": F.lower("source")}).drop("label", "source")
    return left.join(right, ["_l", "_s"], "right").withColumnsRenamed({"_l": "label", "_s": "source"})


def taxonomy_parents(rows: DataFrame, ranks: Sequence[str], position: str) -> DataFrame:
    """Each value's parent: the value one given rank up, in the first row that has both."""
    pairs = None
    for up, down in zip(ranks, ranks[1:], strict=False):
        p = rows.select(F.col(down).alias("child"), F.col(up).alias("parent"), position)
        pairs = p if pairs is None else pairs.unionByName(p)
    given = pairs.where(F.coalesce(F.col("child") != ABSENT, F.lit(False)) & F.coalesce(F.col("parent") != ABSENT, F.lit(False)))
    return given.groupBy("child").agg(F.min_by("parent", position).alias("parent"))


def rank_index(names: DataFrame, channel: str, name: str) -> DataFrame:
    rank, value = rank_and_value(F.col(name))
    return names.select(channel, rank.alias("rank"), value.alias("value"))


def rank_groups(names: DataFrame, channel: str, name: str) -> DataFrame:
    """First channel and width of each rank in a channel list."""
    return rank_index(names, channel, name).where("rank is not null").groupBy("rank").agg(F.min(channel).alias("first"), F.count(F.lit(1)).alias("width"))


def first_argmax(a: Column) -> Column:
    """Position from 0 of the first greatest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def dense_target(channels: Column) -> tuple[Column, Column]:
    """From taxonomic channels: the active class (first 2, else 0) and whether there is one."""
    at = F.array_position(channels, 2)
    return F.greatest(at - 1, F.lit(0)).cast("int"), at > 0


def dense_id(channels: Column) -> Column:
    """0 for all zeros, else the first greatest channel plus 1."""
    total = F.aggregate(channels, F.lit(0), lambda s, x: s + x.cast("int"))
    return F.when(total == 0, 0).otherwise(first_argmax(channels) + 1)


def channel_slices(channels: Column, widths: Sequence[int]) -> list[Column]:
    at, out = 1, []
    for w in widths:
        out.append(F.slice(channels, at, w))
        at += w
    return out


def top_k(values: Column, k: int) -> Column:
    """The k greatest elements as (value, position), equal ones by position."""
    pairs = F.transform(values, lambda x, i: F.struct((-x).alias("neg"), i.alias("position")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p["neg"]).alias("value"), p["position"].alias("position")))


def hierarchical_argmax(probs: Column, levels: Sequence[int], threshold: float = 0.5) -> Column:
    """The best channel of the deepest level whose best exceeds the threshold; -1 for none."""
    out = F.lit(None).cast("int")
    for level in sorted(set(levels), reverse=True):
        at = [i for i, x in enumerate(levels) if x == level]
        part = F.array(*[F.element_at(probs, i + 1) for i in at])
        best = F.element_at(F.array(*[F.lit(i) for i in at]), F.array_position(part, F.array_max(part)).cast("int"))
        out = F.coalesce(out, F.when(F.array_max(part) > threshold, best))
    return F.coalesce(out, F.lit(-1))
