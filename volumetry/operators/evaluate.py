"""Scores of volume pairs: errors, PSNR, SSIM, distribution checks and reports.

Pairs are joined brick by brick and stay packed (``ab``: array of structs) until a statistic needs
single samples, so per-pair parameters are joined to bricks. A brick without an equal partner stays,
with the other side null: a pair of unequal grids has null scores, its one-sided statistics are whole.
NaN samples make the scores of their pair NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volumetry.operators.ordering import steps
from volumetry.operators.stats import aggregate_metrics, histogram
from volumetry.operators.stencil import line_sums, stencil
from volumetry.schema import BRICK_SIDE, BROADCAST_ROWS, attach, bricks, combine, voxels
from volumetry.session import cut_lineage

# Stabilisers of the structural similarity index, and the report thresholds.
SSIM_K1, SSIM_K2 = 0.01, 0.03
OUTLIER_STD = 3.0
MAX_OUTLIER_RATIO, MAX_SATURATION, MIN_KS_PVALUE = 0.01, 0.1, 0.01
GOOD_PSNR, GOOD_SSIM = 25.0, 0.85
KS_TERMS = 100

Made = Callable[[Column, Column], Column]  # the generated value of a sample from both sides

EVAL_FIRST = ("subject", "psnr_input", "psnr_generated", "psnr_improvement",
              "ssim_input", "ssim_generated", "ssim_improvement")


def pair_bricks(pairs: DataFrame, packed: DataFrame, value: str = "value", n_pairs: int | None = None,
                keys: Sequence[str] = ("pair_id",), generated: DataFrame | None = None) -> DataFrame:
    """Packed pairs: ``pairs`` has ``input_id`` and ``target_id``; bricks meet on their origin and dims.
    ``generated`` are bricks with the id of the input volume, a third side ``g``."""
    small = n_pairs is not None and n_pairs <= BROADCAST_ROWS

    def side(ident: str, name: str, packed: DataFrame = packed) -> DataFrame:
        ids = pairs.select(*keys, F.col(ident).alias("volume_id"))
        joined = packed.join(F.broadcast(ids) if small else ids, "volume_id")
        return joined.select(*keys, "origin", "dims", F.col(value).alias(name))

    sides = {"a": side("input_id", "a"), "b": side("target_id", "b")}
    if generated is not None:
        sides["g"] = side("input_id", "g", generated)
    every = reduce(lambda l, r: l.join(r, [*keys, "origin", "dims"], "full"), sides.values())
    n = F.coalesce(*[F.array_size(c) for c in sides])
    filled = [F.coalesce(F.col(c), F.array_repeat(F.lit(None).cast(every.schema[c].dataType.elementType), n)).alias(c) for c in sides]
    return every.select(*keys, "origin", "dims", F.arrays_zip(*filled).alias("ab"))


def pair_voxels(df: DataFrame) -> DataFrame:
    """Long rows ``(keys..., x, y, z, a, b)``."""
    if "ab" not in df.columns:
        return df
    flat = voxels(df, "ab")
    rest = [c for c in flat.columns if c != "ab"]
    return flat.select(*rest, *[F.col(f"ab.{c}").cast("double").alias(c) for c in _names(df)])


def _names(df: DataFrame) -> list[str]:
    """Sides of a pair table: ``a``, ``b`` and perhaps ``g``."""
    held = df.schema["ab"].dataType.elementType.names if "ab" in df.columns else df.columns
    return [c for c in ("a", "b", "g") if c in held]


def _with_generated(df: DataFrame, generated: Made | None) -> DataFrame:
    """Long rows with ``g``: made by the function, or a side of its own."""
    rows = pair_voxels(df)
    return rows.withColumn("g", generated(F.col("a"), F.col("b"))) if generated else rows


def shape_check(pairs: DataFrame, volumes: DataFrame) -> DataFrame:
    """Whether both volumes of a pair have the same grid; decided on headers."""
    shape = volumes.select("volume_id", "shape")
    a = shape.withColumnsRenamed({"volume_id": "input_id", "shape": "_sa"})
    b = shape.withColumnsRenamed({"volume_id": "target_id", "shape": "_sb"})
    return pairs.join(a, "input_id").join(b, "target_id").select(
        *pairs.columns, (F.col("_sa") == F.col("_sb")).alias("shape_match"))


def _decibel(mse: Column, span: Column) -> Column:
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(
        F.lit(10.0) * F.log10(span * span / F.when(mse != 0, mse)))


def _whole(x: Column, y: Column) -> Column:
    """Whether every sample of the group has both sides."""
    return F.count(x - y) == F.count(F.lit(1))


def pair_metrics(df: DataFrame, keys: Sequence[str] = ("pair_id",), a: str = "a", b: str = "b",
                 span: float | None = None) -> DataFrame:
    """L1, MSE and PSNR in one aggregation; the range is that of the target unless given. ``n`` counts
    samples with both sides; where some have one only, ``shape_match`` is false and the scores are null."""
    x, y = F.col(a), F.col(b)
    agg = pair_voxels(df).groupBy(*keys).agg(
        F.count(x - y).alias("n"), _whole(x, y).alias("shape_match"), F.when(_whole(x, y), F.avg(F.abs(x - y))).alias("l1"),
        F.when(_whole(x, y), F.avg((x - y) * (x - y))).alias("mse"), (F.max(y) - F.min(y)).alias("_range"))
    width = F.lit(float(span)) if span is not None else F.col("_range")
    return agg.withColumn("psnr", _decibel(F.col("mse"), width)).drop("_range")


def batch_psnr(df: DataFrame, batch: Sequence[str], by: Sequence[str] = (), a: str = "a", b: str = "b") -> DataFrame:
    """Mean over batches of the PSNR for peak 1; a perfect batch adds 0 but counts. A batch with samples of
    one side only has no score: it enters neither the mean, which is null without any, nor ``n_batches``."""
    x, y = F.col(a), F.col(b)
    mse = pair_voxels(df).groupBy(*by, *batch).agg(F.when(_whole(x, y), F.avg((x - y) * (x - y))).alias("_mse"))
    score = F.lit(20.0) * F.log10(F.lit(1.0) / F.sqrt("_mse"))
    one = F.when(F.col("_mse") > 0, score).when(F.col("_mse").isNotNull(), F.lit(0.0))
    return mse.groupBy(*by).agg(F.avg(one).alias("psnr"), F.count("_mse").alias("n_batches"))


def normalized_metrics(df: DataFrame, keys: Sequence[str] = ("pair_id",), groups: int | None = None,
                       eps: float = 1e-8) -> DataFrame:
    """PSNR for range 1 after each side was scaled to its own min and max."""
    return pair_metrics(normalize_sides(df, keys, groups, eps), keys, span=1.0)


def normalized_ssim(df: DataFrame, keys: Sequence[str] = ("pair_id",), win: int = 7, groups: int | None = None,
                    eps: float = 1e-8, side: int = BRICK_SIDE) -> DataFrame:
    """Structural similarity for range 1 of the sides scaled the same way; packed pairs stay packed."""
    return ssim(normalize_sides(df, keys, groups, eps), keys, None, win, span=1.0, groups=groups, side=side)


def normalize_sides(df: DataFrame, keys: Sequence[str] = ("pair_id",), groups: int | None = None,
                    eps: float = 1e-8) -> DataFrame:
    ends = pair_voxels(df).groupBy(*keys).agg(
        *[f(c).alias(f"_{n}_{c}") for c in ("a", "b") for n, f in (("lo", F.min), ("hi", F.max))])
    based = attach(df, ends, keys, groups)
    scaled = lambda v, c: (v.cast("double") - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + eps)
    if "ab" in df.columns:
        out = based.withColumn("ab", F.transform("ab", lambda s: F.struct(*[scaled(s[c], c).alias(c) for c in ("a", "b")])))
    else:
        out = based.withColumns({c: scaled(F.col(c), c) for c in ("a", "b")})
    return out.drop("_lo_a", "_hi_a", "_lo_b", "_hi_b")


def _sides(df: DataFrame, keys: list[str], generated: Made | None, side: int) -> DataFrame:
    """Packed arrays ``a``, ``b`` and, where made or given, ``g``; null where a side is missing."""
    if "ab" in df.columns:
        sides = {c: F.col(f"ab.{c}") for c in _names(df)}
        if generated:
            sides["g"] = F.transform("ab", lambda s: generated(s["a"].cast("double"), s["b"].cast("double")))
        return df.select(*keys, "origin", "dims", *[F.when(~F.exists(v, F.isnull), v).alias(c) for c, v in sides.items()])
    rows = _with_generated(df, generated)
    return bricks(rows, keys, _names(rows), side)


def _brick_similarity(others: tuple[str, ...], win: int):
    """Sum and number of similarity values of one padded brick, over the windows inside the grid. NaN
    samples, and flat pairs of range 0, make the sum NaN."""
    size = float(win**3)
    even = [np.full(win, 1.0 / win)] * 3

    def run(blocks: dict[str, np.ndarray], params: dict[str, object]) -> dict[str, object]:
        width = float(params["_range"])
        c1, c2 = (SSIM_K1 * width) ** 2, (SSIM_K2 * width) ** 2
        scale = size / (size - 1.0)
        inside = params["_inside"]
        n = int(np.prod([max(s.stop - s.start - win + 1, 0) for s in inside]))
        if n == 0:
            return {"n": 0, **{o: 0.0 for o in others}}
        t = blocks["b"][inside]
        mean_t = line_sums(t, even)
        var_t = scale * (line_sums(t * t, even) - mean_t**2)
        out: dict[str, object] = {"n": n}
        for o in others:
            v = blocks[o][inside]
            mean = line_sums(v, even)
            var, cov = scale * (line_sums(v * v, even) - mean**2), scale * (line_sums(v * t, even) - mean * mean_t)
            with np.errstate(divide="ignore", invalid="ignore"):
                index = ((2 * mean * mean_t + c1) * (2 * cov + c2)) / ((mean**2 + mean_t**2 + c1) * (var + var_t + c2))
            out[o] = float(index.sum())
        return out

    return run


def ssim(df: DataFrame, keys: Sequence[str] = ("pair_id",), generated: Made | None = None, win: int = 7,
         span: float | None = None, groups: int | None = None, ranges: DataFrame | None = None,
         side: int = BRICK_SIDE) -> DataFrame:
    """Mean structural similarity of ``a`` (and of the generated side) with ``b``; null where the grid
    is smaller than the window or the grids differ, NaN where a sample is NaN or both sides are flat.
    Windows are uniform with sample covariance. Bricks exchange halos of
    ``win // 2`` and each gives one sum and one count. ``ranges`` holds ``_range`` of b where known."""
    keys = list(keys)
    sides = _sides(df, keys, generated, side)
    if span is not None:
        ranged = sides.withColumn("_range", F.lit(float(span)))
    else:
        if ranges is None:
            ranges = pair_voxels(df).groupBy(*keys).agg((F.max("b") - F.min("b")).alias("_range"))
        ranged = attach(sides, ranges, keys, groups, "inner")
    others = ("a", "g") if "g" in sides.columns else ("a",)
    per_brick = stencil(ranged, _brick_similarity(others, win), {"n": "long", **{o: "double" for o in others}},
                        win // 2, keys, ["b", *others], ["_range"], side)
    return per_brick.groupBy(*keys).agg(*[
        F.when((F.sum("n") > 0) & (F.count("n") == F.count(F.lit(1))), F.sum(o) / F.sum("n")).alias(f"ssim_{o}")
        for o in others])


def evaluate(df: DataFrame, generated: Made | None = None, keys: Sequence[str] = ("pair_id",), win: int = 7,
             groups: int | None = None) -> DataFrame:
    """Input against target, generated against target, and the improvement between them. The generated
    side is a formula of both, or the bricks given to ``pair_bricks``."""
    rows = _with_generated(df, generated)
    a, b, g = F.col("a"), F.col("b"), F.col("g")
    agg = cut_lineage(rows.groupBy(*keys).agg(
        F.when(_whole(a, b), F.avg(F.abs(a - b))).alias("l1_input"),
        F.when(_whole(g, b), F.avg(F.abs(g - b))).alias("l1_generated"),
        F.when(_whole(a, b), F.avg((a - b) * (a - b))).alias("_ma"),
        F.when(_whole(g, b), F.avg((g - b) * (g - b))).alias("_mg"),
        (F.max(b) - F.min(b)).alias("_range")), "errors")
    out = combine(agg, ssim(df, keys, generated, win, groups=groups, ranges=agg.select(*keys, "_range")), keys, groups)
    psnr_a, psnr_g = _decibel(F.col("_ma"), F.col("_range")), _decibel(F.col("_mg"), F.col("_range"))
    return out.select(
        *keys, psnr_a.alias("psnr_input"), psnr_g.alias("psnr_generated"), (psnr_g - psnr_a).alias("psnr_improvement"),
        F.col("ssim_a").alias("ssim_input"), F.col("ssim_g").alias("ssim_generated"),
        (F.col("ssim_g") - F.col("ssim_a")).alias("ssim_improvement"), "l1_input", "l1_generated")


def consistency(df: DataFrame, keys: Sequence[str] = ("pair_id",), groups: int | None = None) -> DataFrame:
    """Range, moments, share beyond three std of both sides; saturation of the first side."""
    rows = pair_voxels(df)
    base = rows.groupBy(*keys).agg(*[
        f(c).alias(f"{c}_{n}") for c in ("a", "b")
        for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))])
    base = cut_lineage(base, "sides")
    far = lambda c: F.avg((F.abs(F.col(c) - F.col(f"{c}_mean")) > OUTLIER_STD * F.col(f"{c}_std")).cast("int"))
    ends = (F.col("a") == F.col("a_min")).cast("int") + (F.col("a") == F.col("a_max")).cast("int")
    second = pair_voxels(attach(df, base, keys, groups)).groupBy(*keys).agg(
        far("a").alias("a_outlier_ratio"), far("b").alias("b_outlier_ratio"), F.avg(ends).alias("saturation_ratio"))
    return combine(base, second, keys, groups)


def ks_2samp(df: DataFrame, keys: Sequence[str] = ("pair_id",), groups: int | None = None, report: bool = False) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic over all samples, with the asymptotic p-value. Counts of an interval
    of values give its gap at the end and bound the gap inside; only intervals whose bound is above the best gap of
    their pair are opened. ``report`` adds ``n_samples`` and ``n_opened``, the samples in opened intervals."""
    flat = pair_voxels(df).select(*keys, F.explode(F.array(
        F.struct(F.col("a").alias("v"), F.lit(1).alias("na"), F.lit(0).alias("nb")),
        F.struct(F.col("b").alias("v"), F.lit(0).alias("na"), F.lit(1).alias("nb")))).alias("_s")).select(
        *keys, "_s.*").where(F.col("v").isNotNull())
    low = lambda c: F.try_divide(f"{c}_before", f"{c}_total")
    high = lambda c: F.try_divide(F.col(f"{c}_before") + F.col(c), f"{c}_total")
    gap = F.abs(high("na") - high("nb"))
    cut = steps(flat, keys, "v", {"na": F.col("na"), "nb": F.col("nb")},
                lambda: F.greatest(high("na") - low("nb"), high("nb") - low("na")) > F.max(gap).over(Window.partitionBy(*keys)),
                groups=groups)
    both = F.col("na") + F.col("nb")
    seen = [F.sum(both).alias("n_samples"), F.sum(F.when(F.col("_opened"), both).otherwise(0)).alias("n_opened")]
    stat = cut.groupBy(*keys).agg(
        F.max(gap).alias("ks_statistic"), F.max("na_total").alias("_m"), F.max("nb_total").alias("_n"), *seen)
    lam = F.sqrt(F.col("_m") * F.col("_n") / (F.col("_m") + F.col("_n"))) * F.col("ks_statistic")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0), lambda s, k: s + F.when(
        k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * lam * lam))
    p = F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))
    return stat.select(*keys, "ks_statistic", p.alias("ks_pvalue"), *(["n_samples", "n_opened"] if report else []))


def consistency_warnings(checks: DataFrame) -> DataFrame:
    """Names of the rules a pair breaks."""
    rules = {
        "shape_mismatch": ~F.coalesce(F.col("shape_match"), F.lit(True)),
        "outliers": F.col("a_outlier_ratio") > MAX_OUTLIER_RATIO,
        "saturation": F.col("saturation_ratio") > MAX_SATURATION,
        "distribution": F.col("ks_pvalue") < MIN_KS_PVALUE,
    }
    return checks.withColumn("warnings", F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])))


def verdict(df: DataFrame, psnr: str = "psnr", ssim_col: str = "ssim") -> DataFrame:
    good = (F.col(psnr) > GOOD_PSNR) & (F.col(ssim_col) > GOOD_SSIM)
    return df.withColumn("verdict", F.when(good, "good").otherwise("needs work"))


def eval_aggregate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return aggregate_metrics(df, columns)


def eval_histograms(df: DataFrame, generated: Made | None = None, keys: Sequence[str] = ("pair_id",), bins: int = 100,
                    groups: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Histograms of input, target and generated samples, and their mean and std."""
    rows = _with_generated(df, generated)
    long = rows.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("role"), F.col(c).alias("value")) for n, c in (("input", "a"), ("target", "b"), ("generated", "g"))
    ])).alias("_s")).select(*keys, "_s.*").where(F.col("value").isNotNull())
    by = [*keys, "role"]
    stats = long.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return histogram(long, by, "value", bins, groups=None if groups is None else 3 * groups), stats
