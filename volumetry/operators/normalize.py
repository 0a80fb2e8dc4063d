"""Intensity normalisation inside a region of interest, applied to the whole volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetry.config import NORMALIZATIONS, check_choice
from volumetry.operators.ordering import percentiles
from volumetry.schema import attach, combine, finite, positive, samples, voxels
from volumetry.session import cut_lineage


def clip(v: Column, lo: Column, hi: Column) -> Column:
    """Limits to [lo, hi]; NaN stays NaN, a null limit changes nothing."""
    return F.when(lo.isNull() | F.isnan(v), v).otherwise(F.greatest(F.least(v, hi), lo))


def _roi(df: DataFrame, mask: str | None):
    """Rows and predicate of the region: the mask where given, else the positive values."""
    if mask:
        return df.where(F.col(mask)), finite
    return df, lambda v: positive(v) & finite(v)


def clip_limits(df: DataFrame, keys: Sequence[str], value: str = "value", lo: float = 0.5, hi: float = 99.5,
                mask: str | None = None, groups: int | None = None) -> DataFrame:
    rows, keep = _roi(df, mask)
    found = percentiles(rows, keys, value, [lo, hi], keep, groups)
    return found.select(*keys, F.col("pct")[0].alias("clip_lo"), F.col("pct")[1].alias("clip_hi"))


def clip_percentile(df: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "value", lo: float = 0.5,
                    hi: float = 99.5, mask: str | None = None, groups: int | None = None) -> DataFrame:
    """Clips the whole volume to percentiles of its region; an empty region changes nothing."""
    limits = clip_limits(df, keys, value, lo, hi, mask, groups)
    rows = voxels(attach(df, limits, keys, groups), value)
    clipped = clip(F.col(value).cast("double"), F.col("clip_lo"), F.col("clip_hi"))
    return rows.withColumn(value, clipped).drop("clip_lo", "clip_hi")


def normalize(df: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "value", method: str = "zscore",
              lower: float = 1.0, upper: float = 99.0, clip_range: tuple[float, float] | None = (0.5, 99.5),
              mask: str | None = None, groups: int | None = None) -> DataFrame:
    """``zscore``, ``minmax`` or ``percentile``.

    Without a mask the region is found again after the clip. A background of zeros is then lifted
    to the (positive) lower limit and counts as region, as in the original method; give a mask to
    keep the statistics to the foreground.
    """
    check_choice("normalization", method, NORMALIZATIONS)
    keys = list(keys)
    v = F.col(value).cast("double")
    if clip_range:
        # one small row per volume, read by every later pass: stored once instead of planned thrice
        limits = cut_lineage(clip_limits(df, keys, value, *clip_range, mask=mask, groups=groups))
        based = attach(df, limits, keys, groups)
        v = clip(v, F.col("clip_lo"), F.col("clip_hi"))
    else:
        based = df
    flat = samples(based.select(*keys, value, *([mask] if mask else []),
                                *(["clip_lo", "clip_hi"] if clip_range else [])), value)
    rows, keep = _roi(flat.withColumn("_v", v), mask)
    if method == "percentile":
        scale = percentiles(rows, keys, "_v", [lower, upper], keep, groups).select(
            *keys, F.col("pct")[0].alias("_a"), F.col("pct")[1].alias("_b"))
    elif method == "minmax":
        scale = rows.where(keep(F.col("_v"))).groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    else:
        scale = rows.where(keep(F.col("_v"))).groupBy(*keys).agg(
            F.avg("_v").alias("_a"), F.stddev_pop("_v").alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    width = b if method == "zscore" else b - a
    scaled = F.when(width > 0, (v - a) / width).otherwise(v)
    if method == "percentile":
        scaled = F.when(width > 0, clip((v - a) / width, F.lit(0.0), F.lit(1.0))).otherwise(v)
    out = voxels(attach(based, scale, keys, groups), value).withColumn(value, scaled)
    return out.drop("clip_lo", "clip_hi", "_a", "_b")


def minmax_eps(df: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "value", eps: float = 1e-8,
               groups: int | None = None) -> DataFrame:
    """``(v - min) / (max - min + eps)`` over all samples of the volume."""
    v = F.col(value).cast("double")
    scale = samples(df.select(*keys, value), value).groupBy(*keys).agg(F.min(v).alias("_a"), F.max(v).alias("_b"))
    rows = voxels(attach(df, scale, keys, groups), value)
    return rows.withColumn(value, (v - F.col("_a")) / (F.col("_b") - F.col("_a") + eps)).drop("_a", "_b")


def display_window(df: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "value",
                   groups: int | None = None) -> DataFrame:
    """1st and 99th percentile of nonzero samples, and the full range shared for a comparison."""
    v = F.col(value).cast("double")
    window = percentiles(df, keys, value, [1.0, 99.0], lambda c: (c != 0) & finite(c), groups).select(
        *keys, F.col("pct")[0].alias("window_low"), F.col("pct")[1].alias("window_high"))
    full = samples(df.select(*keys, value), value).groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"))
    return combine(full, window, keys, groups)


def scale_slice(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Min-max scaling of each slice for display; a flat slice stays as it is."""
    v = F.col(value).cast("double")
    scale = df.groupBy(*keys).agg(F.min(v).alias("_a"), F.max(v).alias("_b"))
    out = df.join(scale, list(keys))
    return out.withColumn(value, F.when(F.col("_b") > F.col("_a"), (v - F.col("_a")) / (F.col("_b") - F.col("_a")))
                          .otherwise(v)).drop("_a", "_b")
