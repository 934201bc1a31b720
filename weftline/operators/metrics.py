"""Evaluation metrics from target/prediction pairs, and metric policy over epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECTION = {"loss": "min", "accuracy": "max", "miou": "max", "f1-score": "max"}


def canonical_metric(name: str) -> str:
    key = name.lower().strip()
    if key not in DIRECTION:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(sorted(DIRECTION))}")
    return key


def confusion(pairs: DataFrame, target: str, predicted: str, ignore: int | None = 0) -> DataFrame:
    """Counts of target against prediction, without rows whose target is ignored."""
    rows = pairs if ignore is None else pairs.where(F.col(target) != ignore)
    return rows.groupBy(F.col(target).alias("target"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(matrix: DataFrame) -> DataFrame:
    """Share of all counted rows that are right (micro accuracy)."""
    right = F.coalesce(F.sum(F.when(F.col("target") == F.col("predicted"), F.col("n"))), F.lit(0))
    return matrix.agg(F.sum("n").alias("n"), (right / F.nullif(F.sum("n"), F.lit(0))).alias("accuracy"))


def per_class(matrix: DataFrame) -> DataFrame:
    """tp, fp, fn, recall ("accuracy"), F1 and IoU of each class that is a target or a prediction."""
    sides = matrix.select(F.col("target").alias("class"), F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("target") != F.col("predicted"), F.col("n")).otherwise(0).alias("fn"))
    wrong = matrix.where("target != predicted").select(F.col("predicted").alias("class"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn"))
    sums = sides.unionByName(wrong).groupBy("class").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return sums.select("class", "tp", "fp", "fn", safe(tp, tp + fn).alias("accuracy"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), safe(tp, tp + fp + fn).alias("iou"))


def macro(classes: DataFrame) -> DataFrame:
    """Unweighted means over the classes that occur as target or prediction."""
    return classes.agg(F.avg("accuracy").alias("macro_accuracy"), F.avg("f1").alias("macro_f1"), F.avg("iou").alias("mean_iou"))


def concept_accuracies(rows: DataFrame, concept: str, target: str, predicted: str) -> DataFrame:
    """Accuracy per concept over rows whose target is given (not 0)."""
    given = rows.where(F.col(target) != 0)
    return given.groupBy(concept).agg(F.avg((F.col(target) == F.col(predicted)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def masked_mean(value: Column, mask: Column, damping: float = 0.0) -> Column:
    """Sum over the mask divided by its size plus ``damping``; 0 for an empty mask."""
    n = F.count_if(mask)
    return F.coalesce(F.sum(F.when(mask, value)) / F.nullif(n + F.lit(damping), F.lit(0.0)), F.lit(0.0))


def rank_loss(probability: Column, valid: Column, damping: float = 0.0, least: float = 1e-6) -> Column:
    """Masked mean of the negative log of the active class's probability."""
    return masked_mean(-F.log(F.greatest(probability, F.lit(least))), valid, damping)


def multi_hot_loss(probability: Column, label: Column, damping: float = 0.0, least: float = 1e-6) -> Column:
    """Masked mean of the binary cross-entropy of concepts: label 0 is not given, 1 false, 2 true (smoothed to 0.01 and 0.99)."""
    p = F.greatest(F.least(probability, F.lit(1 - least)), F.lit(least))
    y = F.when(label == 2, F.lit(0.99)).otherwise(F.lit(0.01))
    return masked_mean(-(y * F.log(p) + (1 - y) * F.log(1 - p)), label > 0, damping)


def concept_loss(parts: DataFrame, keys: Sequence[str], name: str, loss: str, ranks: int) -> DataFrame:
    """Summed concept loss per key: each rank counts 1/ranks, the multi-hot part once."""
    share = F.when(F.col(name) == "multi_hot", F.col(loss)).otherwise(F.col(loss) / ranks)
    return parts.groupBy(*keys).agg(F.sum(share).alias("concepts"))


def running_mean(history: DataFrame, series: str, step: str, value: str) -> DataFrame:
    """The mean of all values up to each step."""
    upto = Window.partitionBy(series).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return history.withColumn("running", F.avg(value).over(upto))


def failure_rates(loads: DataFrame, epoch: str, failed: str, most: float = 0.05) -> DataFrame:
    """Loads, failures and their rate per epoch, and whether the rate is over ``most``."""
    out = loads.groupBy(epoch).agg(F.count(F.lit(1)).alias("loads"), F.count_if(F.col(failed)).alias("failures"))
    rate = F.col("failures") / F.col("loads")
    return out.withColumn("rate", rate).withColumn("too_many", rate > most)


class TooManyFailures(RuntimeError):
    """An epoch in which more loads failed than allowed."""


def guard_failures(rates: DataFrame, epoch: str) -> DataFrame:
    """The rates, or an error that names the first epoch with too many failures."""
    bad = rates.where("too_many").orderBy(epoch).limit(1).collect()
    if bad:
        raise TooManyFailures(f"epoch {bad[0][epoch]}: {bad[0].failures} of {bad[0].loads} loads failed")
    return rates


def early_stopping(history: DataFrame, series: str, epoch: str, metric: str, direction: str, patience: int, min_delta: float = 0.0) -> DataFrame:
    """Per series: the best epoch and value, and the epoch at which training stops (null: at the end).

    An epoch improves on the best one before it only by more than ``min_delta``,
    so the best value is a fold over the epochs; training stops after
    ``patience`` epochs in a row that do not. A series is an array in one row: it
    has as many entries as epochs.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("double").alias("at"), F.col(metric).cast("double").alias("value"))))
    start = F.struct(
        F.lit(None).cast("double").alias("best"), F.lit(None).cast("double").alias("best_at"), F.lit(0).alias("waited"), F.lit(None).cast("double").alias("stop")
    )

    def step(s, e):
        gain = e["value"] - s["best"] if direction == "max" else s["best"] - e["value"]
        better = s["best"].isNull() | (gain > min_delta)
        waited = F.when(better, 0).otherwise(s["waited"] + 1)
        new = F.struct(
            F.when(better, e["value"]).otherwise(s["best"]).alias("best"), F.when(better, e["at"]).otherwise(s["best_at"]).alias("best_at"),
            waited.alias("waited"), F.when(waited >= patience, e["at"]).alias("stop"),
        )
        return F.when(s["stop"].isNotNull(), s).otherwise(new)

    out = history.groupBy(series).agg(steps.alias("_steps")).withColumn("_end", F.aggregate("_steps", start, step))
    at = lambda c: F.col(f"_end.{c}").cast(history.schema[epoch].dataType)
    return out.select(series, at("best_at").alias("best_epoch"), F.col("_end.best").alias("best"), at("stop").alias("stop_epoch"))


def best_so_far(history: DataFrame, series: str, epoch: str, metric: str, direction: str) -> DataFrame:
    """Best value up to each epoch, whether it is new, and epochs since the last improvement."""
    upto = Window.partitionBy(series).orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(series).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    best, past = (F.min, F.max)[direction == "max"](metric), (F.min, F.max)[direction == "max"](metric).over(before)
    better = F.col(metric) > past if direction == "max" else F.col(metric) < past
    rows = history.withColumn("best", best.over(upto)).withColumn("improved", F.coalesce(better, past.isNull()))
    place = F.row_number().over(Window.partitionBy(series).orderBy(epoch))
    rows = rows.withColumn("_at", place)
    return rows.withColumn("waited", F.col("_at") - F.max(F.when(F.col("improved"), F.col("_at"))).over(upto)).drop("_at")


def unpack(rows: DataFrame, keys: Sequence[str], values: str, names: DataFrame) -> DataFrame:
    """One row per array element, named by ``names`` (position, name), else class_<position>."""
    long = rows.select(*keys, F.posexplode(values).alias("position", "value"))
    named = long.join(names.select("position", "name"), "position", "left")
    return named.withColumn("name", F.coalesce("name", F.concat(F.lit("class_"), F.col("position").cast("string"))))


def throughput(samples: Column, seconds: Column, loading: Column) -> tuple[Column, Column]:
    """Samples per second, and the percentage of time spent loading."""
    return samples / F.nullif(seconds, F.lit(0)), 100 * loading / F.nullif(seconds, F.lit(0))
