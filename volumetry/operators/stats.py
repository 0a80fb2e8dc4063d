"""Counts, moments, percentiles, histograms and their cumulative forms, per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volumetry.functions.binning import bin_edge, bin_of, widened
from volumetry.operators.ordering import Keep, percentiles
from volumetry.schema import attach, combine, finite, samples
from volumetry.session import cut_lineage


def nonzero(v: Column) -> Column:
    return v != 0


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, rows: str, cols: str, values: Sequence[str] | None = None) -> DataFrame:
    """Counts with one column per value of ``cols``; give ``values`` to save a pass."""
    counted = df.groupBy(rows).pivot(cols, list(values) if values else None)
    return counted.agg(F.count(F.lit(1))).fillna(0)


def inventory(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of each column with their counts, as one long table ``(column, entry, n)``."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("entry")) for c in columns
    ])).alias("_e")).select("_e.*").where(F.col("entry").isNotNull())
    return long.groupBy("column", "entry").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    """How many distinct values each column has."""
    return inventory(df, *columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def moments(df: DataFrame, keys: Sequence[str], value: str = "value", where: Keep = finite,
            sample_std: bool = False) -> DataFrame:
    """count, mean, std, min and max of the kept values; population std unless told otherwise."""
    v = F.col(value)
    kept = F.when(where(v), v.cast("double"))
    spread = F.stddev_samp if sample_std else F.stddev_pop
    return samples(df.select(*keys, value), value).groupBy(*keys).agg(
        F.count(kept).alias("n"), F.avg(kept).alias("mean"), spread(kept).alias("std"),
        F.min(kept).alias("min"), F.max(kept).alias("max"),
    )


def volume_stats(df: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "value",
                 where: Keep = nonzero, groups: int | None = None) -> DataFrame:
    """Statistics record over nonzero values; an empty volume keeps zeros and null p01/p99."""
    keep = lambda v: where(v) & finite(v)
    base = cut_lineage(moments(df, keys, value, keep), "moments")
    ends = base.where(F.col("n") > 0).select(*keys, F.col("min").alias("_lo"), F.col("max").alias("_hi"))
    order = percentiles(df, keys, value, [50.0, 1.0, 99.0], keep, groups, bounds=ends).drop("n")
    joined = combine(base, order, keys, groups)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        *keys, "n", *[zero(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")],
        zero(F.col("pct")[0]).alias("median"),
        F.col("pct")[1].alias("p01"), F.col("pct")[2].alias("p99"),
    )


def cohort_stats(df: DataFrame, by: Sequence[str] = ("split",), value: str = "value",
                 volume: str = "volume_id", groups: int | None = None) -> DataFrame:
    """Pooled nonzero statistics of each split with the number of volumes behind them."""
    pooled = volume_stats(df, by, value, groups=groups)
    volumes = df.groupBy(*by, volume).agg(F.lit(1).alias("_one")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_volumes")
    )
    return combine(pooled, volumes, by, groups)


def shape_census(volumes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many volumes have which grid."""
    text = F.array_join(F.transform("shape", lambda s: s.cast("string")), "x")
    return volumes.groupBy(*by, text.alias("grid")).agg(F.count(F.lit(1)).alias("n_volumes"))


def unpivot(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    cast = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(list(ids), list(columns), "metric", "value")


def describe_exact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of each column, exactly."""
    long = unpivot(df, columns)
    base = moments(long, ["metric"], sample_std=True)
    order = percentiles(long, ["metric"], "value", [25.0, 50.0, 75.0], groups=len(columns)).drop("n")
    return combine(base, order, ["metric"], len(columns)).select(
        "metric", F.col("n").alias("count"), "mean", "std", "min",
        F.col("pct")[0].alias("q25"), F.col("pct")[1].alias("q50"), F.col("pct")[2].alias("q75"), "max",
    )


def aggregate_metrics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """mean, sample std, min and max of each metric, one row per metric."""
    return moments(unpivot(df, columns), ["metric"], sample_std=True).select(
        "metric", "mean", "std", "min", "max"
    )


def histogram(df: DataFrame, keys: Sequence[str], value: str = "value", n: int = 256,
              where: Keep = finite, groups: int | None = None, dense: bool = False,
              extra: Sequence[Column] = ()) -> DataFrame:
    """``(keys..., bin, n, lo, hi)`` with numpy's equal-width rule; ``extra`` adds aggregates."""
    keys = list(keys)
    kept = df.select(*keys, value)
    keep = lambda v: where(v) & finite(v)
    v = F.col(value).cast("double")
    raw = samples(kept, value).where(keep(F.col(value))).groupBy(*keys).agg(
        F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi")
    )
    lo, hi = widened(F.col("_lo"), F.col("_hi"))
    bounds = raw.select(*keys, lo.alias("lo"), hi.alias("hi"))
    if dense:
        bounds = cut_lineage(bounds, "bounds")
    rows = samples(attach(kept, bounds, keys, groups, "inner"), value).where(keep(F.col(value)))
    counts = rows.groupBy(*keys, bin_of(v, F.col("lo"), F.col("hi"), n).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *extra
    )
    if not dense:
        return counts
    grid = bounds.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    filled = grid.join(counts.drop("lo", "hi"), keys + ["bin"], "left")
    return filled.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def density(hist: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Adds ``density`` = n / (total * bin width); the window spans at most ``bins`` rows."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return hist.withColumn("density", F.col("n") / (total * width))


def cdf(hist: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Left edge and normalised running sum of a dense histogram (at most ``bins`` rows a group)."""
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy(*keys))
    edge = bin_edge(F.col("bin").cast("double"), F.col("lo"), F.col("hi"), bins)
    return hist.select(*keys, "bin", "n", edge.alias("left_edge"), share.alias("cdf"))


def batch_stats(df: DataFrame, batch: Sequence[str], value: str = "value") -> DataFrame:
    return moments(df, batch, value)


def boxplot_stats(df: DataFrame, keys: Sequence[str], value: str = "value", where: Keep = nonzero,
                  groups: int | None = None, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last sample within ``reach`` quartile ranges, outside count."""
    keep = lambda v: where(v) & finite(v)
    quart = percentiles(df, keys, value, [25.0, 50.0, 75.0], keep, groups).select(
        *keys, F.col("pct")[0].alias("q1"), F.col("pct")[1].alias("median"), F.col("pct")[2].alias("q3")
    )
    v = F.col(value).cast("double")
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - reach * iqr, F.col("q3") + reach * iqr
    rows = samples(attach(df.select(*keys, value), quart, keys, groups, "inner"), value)
    return rows.where(keep(F.col(value))).groupBy(*keys).agg(
        F.min("q1").alias("q1"), F.min("median").alias("median"), F.min("q3").alias("q3"),
        F.least(F.min(F.when(v >= low, v)), F.min("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(v <= high, v)), F.max("q3")).alias("whisker_high"),
        F.count(F.when((v < low) | (v > high), 1)).alias("n_outside"),
    )
