"""Equal-width bins and the monotone cells used for exact distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def widened(lo: Column, hi: Column) -> tuple[Column, Column]:
    """The range of an equal-width histogram: a flat input is widened by one half each way."""
    flat = lo == hi
    return F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)


def bin_of(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Index of the equal-width bin; the last bin is closed. ``hi > lo`` must hold."""
    raw = F.floor((v - lo) / (hi - lo) * F.lit(float(n)))
    return F.least(raw, F.lit(n - 1)).cast("int")


def bin_edge(i: Column, lo: Column, hi: Column, n: int) -> Column:
    return lo + (hi - lo) * i / F.lit(float(n))


def bin_center(i: Column, lo: Column, hi: Column, n: int) -> Column:
    return lo + (hi - lo) * (i + F.lit(0.5)) / F.lit(float(n))


def _spread(v: Column) -> Column:
    """Signed logarithm: keeps the order and stops one outlier from crowding all other values."""
    return F.signum(v) * F.log1p(F.abs(v) * F.lit(float(2**20)))


def cell_of(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Monotone cell in [0, n): smaller values never get a larger cell. Any cut works for exact
    ranks; this one stays even for clustered values as well as for far outliers."""
    a, b, s = _spread(lo), _spread(hi), _spread(v)
    raw = F.floor((s - a) / (b - a) * F.lit(float(n)))
    return F.when(b > a, F.least(F.greatest(raw, F.lit(0)), F.lit(n - 1))).otherwise(F.lit(0)).cast("int")


def count_below(df: DataFrame, points: str, v: Column, n: int, name: str) -> DataFrame:
    """Adds the number of ``points`` (a sorted array of ``n`` values) that are not above ``v``. A binary search
    of one projection a step, so every step is compiled and reads the one before once."""
    out, step = df.withColumn(name, F.lit(0)), 1 << (n.bit_length() - 1)
    while step:
        reached = F.get(points, F.col(name) + (step - 1)) <= v
        out = out.withColumn(name, F.col(name) + F.when(reached, step).otherwise(0))
        step //= 2
    return out
