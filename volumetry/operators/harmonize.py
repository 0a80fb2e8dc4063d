"""Intensity harmonisation between acquisition groups: fit a small model, then transform.

``fit`` is eager, as a fit is: the model table is checkpointed in the shared folder, so its size is
known when ``transform`` decides how to join it, and later plans never fit again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetry.config import check_choice
from volumetry.functions.binning import count_below
from volumetry.operators.ordering import percentiles
from volumetry.operators.stats import cdf, histogram
from volumetry.schema import attach, finite, positive, samples, voxels, with_row
from volumetry.session import cut_lineage

METHODS = ("histogram", "zscore", "quantile")
POINTS = 100


def _kept(v):
    return positive(v) & finite(v)


@dataclass
class HarmonizerModel:
    """A fitted method. ``table`` is None until ``fit`` or ``load``."""

    method: str = "histogram"
    reference: str = "3T"
    group: str = "field_strength"
    bins: int = 256
    table: DataFrame | None = None
    rows: int = 0

    def __post_init__(self) -> None:
        check_choice("harmonisation", self.method, METHODS)

    def fit(self, df: DataFrame, value: str = "value") -> "HarmonizerModel":
        g = self.group
        if self.method == "histogram":
            hist = histogram(df.where(F.col(g) == self.reference), [g], value, self.bins, _kept, 1, dense=True)
            model = cdf(hist, [g], self.bins).select(g, "bin", "left_edge", "cdf")
        elif self.method == "zscore":
            v = F.col(value).cast("double")
            pooled = samples(df.select(g, value), value).where(_kept(F.col(value))).groupBy(g)
            model = pooled.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).withColumn(
                "std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))
        else:
            ps = [100.0 * i / (POINTS - 1) for i in range(POINTS)]
            model = percentiles(df, [g], value, ps, _kept).select(g, F.col("pct").alias("vals"))
        return self._settle(cut_lineage(model))

    def _settle(self, table: DataFrame) -> "HarmonizerModel":
        self.table, self.rows = table, table.count()
        if self.method == "histogram" and self.rows == 0:
            raise ValueError(f"reference group {self.reference!r} has no positive samples")
        return self

    def transform(self, df: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "value",
                  groups: int | None = None) -> DataFrame:
        """Long rows with harmonised positive samples; all others stay as they are."""
        if self.table is None:
            raise ValueError("call fit() or load() before transform()")
        if self.method == "zscore":
            return self._zscore(df, value)
        if self.method == "quantile":
            return self._quantile(df, value)
        return self._histogram(df, list(keys), value, groups)

    def _zscore(self, df: DataFrame, value: str) -> DataFrame:
        v = F.col(value).cast("double")
        rows = voxels(attach(df, self.table, [self.group], self.rows), value)
        own = positive(v) & F.col("mean").isNotNull()
        return rows.withColumn(value, F.when(own, (v - F.col("mean")) / F.col("std")).otherwise(v)).drop("mean", "std")

    def _quantile(self, df: DataFrame, value: str) -> DataFrame:
        """Own quantile position by a binary search in the group's values, which lie beside the brick, then the
        reference value there. No join sees a sample."""
        g, last = self.group, POINTS - 1
        reference = self.table.where(F.col(g) == self.reference).select(F.col("vals").alias("_ref"))
        if reference.isEmpty():
            raise KeyError(f"reference group {self.reference!r} was not fitted")
        v = F.col(value).cast("double")
        # a row of the model holds POINTS values, about ten times what the bound on parameters counts
        flat = voxels(with_row(attach(df, self.table.withColumnRenamed("vals", "_own"), [g], self.rows * POINTS // 10), reference), value)
        names = [c for c in flat.columns if c not in ("_own", "_ref")]
        placed = count_below(flat, "_own", v, POINTS, "_at")
        point = lambda c, i: F.get(c, F.col("_at") + i)
        x0, x1, y0, y1 = point("_own", -1), point("_own", 0), point("_ref", -1), point("_ref", 0)
        inside = y0 + (v - x0) / (x1 - x0) * (y1 - y0)
        out = F.when(~positive(v) | F.col("_own").isNull(), v).when(F.col("_at") == 0, F.col("_ref")[0]).when(
            F.col("_at") > last, F.col("_ref")[last]).otherwise(inside)
        return placed.select(*[out.alias(c) if c == value else F.col(c) for c in names])

    def _histogram(self, df: DataFrame, keys: list[str], value: str, groups: int | None) -> DataFrame:
        """Per volume: reference CDF read in the source CDF, giving a new value for each source bin.

        The map of a volume is one array of ``bins`` values, made from its histogram and joined to its
        packed rows; samples find their bin by arithmetic.
        """
        g, n = self.group, self.bins
        other = df.where(F.col(g).isNull() | (F.col(g) != self.reference))
        shares = np.array([r["cdf"] for r in self.table.orderBy("bin").collect()])  # one value per bin of the model

        @F.pandas_udf("array<double>")
        def source_map(bins: pd.Series, counts: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
            return pd.Series([_bin_map(*v, shares) for v in zip(bins, counts, lo, hi)])

        found = histogram(other, keys, value, n, _kept, groups).groupBy(*keys).agg(
            F.collect_list("bin").alias("_b"), F.collect_list("n").alias("_n"),
            F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
        maps = found.select(*keys, source_map("_b", "_n", "_lo", "_hi").alias("_map"), "_lo",
                            ((F.col("_hi") - F.col("_lo")) / n).alias("_w"))
        rows = voxels(attach(df, maps, keys, None if groups is None else groups * n), value)
        v = F.col(value).cast("double")
        seg = F.least(F.greatest(F.floor((v - F.col("_lo")) / F.col("_w")), F.lit(0)), F.lit(n - 2)).cast("int")
        y0, y1 = F.col("_map")[seg], F.col("_map")[seg + 1]
        new = y0 + (v - F.col("_lo") - seg * F.col("_w")) / F.col("_w") * (y1 - y0)
        moved = positive(v) & F.col("_map").isNotNull() & ~F.coalesce(F.col(g) == self.reference, F.lit(False))
        return rows.withColumn(value, F.when(moved, new).otherwise(v)).drop("_map", "_lo", "_w")

    def save(self, path: str) -> None:
        """Parquet table plus a one-row parquet of the settings; no pickles."""
        if self.table is None:
            raise ValueError("nothing fitted to save")
        self.table.write.mode("overwrite").parquet(f"{path}/model")
        self.table.sparkSession.createDataFrame(
            [(self.method, self.reference, self.group, self.bins)],
            "method string, reference string, group string, bins int",
        ).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "HarmonizerModel":
        s = spark.read.parquet(f"{path}/settings").first()
        return cls(s["method"], s["reference"], s["group"], s["bins"])._settle(spark.read.parquet(f"{path}/model"))


def _bin_map(bins: np.ndarray, counts: np.ndarray, lo: float, hi: float, shares: np.ndarray) -> list[float | None]:
    """New value of each left bin edge: the source edge read at the reference share, linear between
    edges and extended past them; null where the source share makes no step."""
    n = len(shares)
    full = np.zeros(n)
    full[np.asarray(bins)] = counts
    cdf = np.cumsum(full) / full.sum()
    edges = lo + (hi - lo) * np.arange(n) / n
    at = np.clip(np.searchsorted(cdf, shares), 1, n - 1)
    step = cdf[at] - cdf[at - 1]
    slope = (edges[at] - edges[at - 1]) / np.where(step == 0, 1.0, step)
    new = edges[at - 1] + (shares - cdf[at - 1]) * slope
    return [None if s == 0 else float(v) for s, v in zip(step, new)]


def harmonize_report(stages: dict[str, DataFrame], by: Sequence[str], value: str = "value") -> DataFrame:
    """Mean of positive samples per stage and group."""
    out = None
    for name, df in stages.items():
        v = F.col(value).cast("double")
        part = samples(df.select(*by, value), value).where(positive(F.col(value))).groupBy(*by).agg(
            F.avg(v).alias("mean"), F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


