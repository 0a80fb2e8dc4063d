"""Metric history by run, epoch and fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volumetry.operators.stats import moments, unpivot


def epoch_means(log: DataFrame, by: Sequence[str] = ("epoch", "metric")) -> DataFrame:
    return log.groupBy(*by).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_batches"))


def mark_best(log: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Flags epochs strictly below every earlier one; a history has one row per epoch."""
    earlier = Window.partitionBy(*by).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min("value").over(earlier)
    return log.withColumn("is_best", best.isNull() | (F.col("value") < best))


def best_epoch(log: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    first = F.min(F.struct("value", "epoch"))
    return log.groupBy(*by).agg(first.alias("_b")).select(
        *by, F.col("_b.epoch").alias("best_epoch"), F.col("_b.value").alias("best_value"))


def checkpoint_epochs(log: DataFrame, every: int, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Epochs at which a state is saved: every n-th one and each new best."""
    return mark_best(log, by).where((F.col("epoch") % every == 0) | F.col("is_best"))


def overfit(log: DataFrame, by: Sequence[str] = ("metric",), min_epochs: int = 10) -> DataFrame:
    """Least-squares slope over epochs; rising after more than ``min_epochs`` means overfitting."""
    fit = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_epochs"),
        F.regr_slope(F.col("value"), F.col("epoch").cast("double")).alias("slope"))
    return fit.withColumn("overfitting", (F.col("n_epochs") > min_epochs) & (F.col("slope") > 0))


def metric_ratio(log: DataFrame, top: str, bottom: str, by: Sequence[str] = ("epoch",)) -> DataFrame:
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    return log.where(F.col("metric").isin(top, bottom)).groupBy(*by).agg(
        pick(top).alias("_a"), pick(bottom).alias("_b")
    ).select(*by, (F.col("_a") / (F.col("_b") + 1e-8)).alias("ratio"))


def cv_summary(folds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """mean and population std of each metric over the folds."""
    names = [c for c in columns if c != "fold"]
    return moments(unpivot(folds, names), ["metric"]).select("metric", "mean", "std")


def run_summary(log: DataFrame, run: Sequence[str] = ("run",)) -> DataFrame:
    """One JSON document per run: statistics and best epoch of each metric."""
    per = log.groupBy(*run, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.min(F.struct("value", "epoch")).getField("epoch").alias("best_epoch"),
    )
    item = F.struct("metric", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")], "best_epoch")
    return per.groupBy(*run).agg(F.to_json(F.sort_array(F.collect_list(item))).alias("summary"))
