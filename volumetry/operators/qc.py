"""Quality metrics per volume, outlier volumes and their summary.

``qc_metrics`` reads the samples twice: once for all plain aggregates, once for the histogram of
positive values. Each bin is kept in two halves around its centre, so the Otsu threshold (always a
bin centre) splits signal and background exactly without a third pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volumetry.config import check_choice
from volumetry.functions.binning import bin_center, bin_of, widened
from volumetry.operators.ordering import percentiles, steps
from volumetry.operators.stats import histogram, unpivot
from volumetry.schema import attach, combine, finite, positive, samples, voxels
from volumetry.session import cut_lineage

BINS = 256
OUTLIER_METRICS = ("snr", "cnr", "entropy", "foreground_fraction", "mean_intensity", "std_intensity")
OUTLIER_FLAGS = ("has_nan", "has_inf", "is_empty", "has_outliers")
# Rank shares of the in-mask samples taken as the two tissue classes of the contrast ratio.
GREY_BAND = (0.3, 0.5)
WHITE_BAND = (0.7, 0.9)
EXTREME_STD = 10.0


def _kept(v: Column) -> Column:
    return positive(v) & finite(v)


def otsu(df: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "value", bins: int = BINS,
         groups: int | None = None) -> DataFrame:
    """Threshold of positive samples that maximises the variance between the two classes."""
    hist = histogram(df, keys, value, bins, _kept, groups)
    return _otsu_of(hist, keys, bins)


def _otsu_of(hist: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Class variance needs only bin numbers (centres are linear in them), so all sums are whole."""
    below = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    n1, s1 = F.sum("n").over(below), F.sum(F.col("n") * F.col("bin")).over(below)
    n, s = F.sum("n").over(every), F.sum(F.col("n") * F.col("bin")).over(every)
    rows = hist.select(*keys, "bin", "lo", "hi", n1.alias("n1"), s1.alias("s1"),
                       (n - n1).alias("n2"), (s - s1).alias("s2"))
    gap = F.col("s1") / F.col("n1") - F.col("s2") / F.when(F.col("n2") > 0, F.col("n2"))
    spread = F.round(F.col("n1").cast("double") * F.col("n2") * gap * gap, 6)
    best = rows.groupBy(*keys).agg(
        F.min(F.when(F.col("n2") > 0, F.struct((-spread).alias("s"), F.col("bin")))).getField("bin").alias("_b"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # a flat volume has one bin around its only value: that value is the middle of the range
    flat = (F.col("lo") + F.col("hi")) / 2
    center = bin_center(F.col("_b").cast("double"), F.col("lo"), F.col("hi"), bins)
    return best.select(*keys, F.coalesce(center, flat).alias("threshold"))


def snr(df: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "value", mask: str | None = None,
        groups: int | None = None) -> DataFrame:
    """mean(signal) / std(background); 0 when a side is empty or the background is flat."""
    v = F.col(value).cast("double")
    if mask:
        signal, noise = F.when(F.col(mask), v), F.when(~F.col(mask), v)
        rows = df
    else:
        rows = samples(attach(df.select(*keys, value), otsu(df, keys, value, groups=groups), keys, groups), value)
        cut = F.col("threshold")
        signal = F.when(positive(v) & (v > cut), v)
        noise = F.when(positive(v) & (v <= cut), v)
    agg = rows.groupBy(*keys).agg(F.avg(signal).alias("_m"), F.stddev_pop(noise).alias("_s"))
    return agg.select(*keys, _ratio(F.col("_m"), F.col("_s")).alias("snr"))


def _ratio(mean: Column, std: Column) -> Column:
    return F.coalesce(F.when(std > 0, mean / std), F.lit(0.0))


def cnr(df: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "value", mask: str = "in_mask",
        groups: int | None = None) -> DataFrame:
    """Contrast of two rank bands of in-mask samples over the background std."""
    n = F.col("m_total").cast("double")
    start, end = F.col("m_before"), F.col("m_before") + F.col("m")
    at = lambda share: F.floor(F.lit(share) * n)

    def crossed() -> Column:
        """Only intervals with an end of a band inside them are opened; the others lie in a band or beside it."""
        return reduce(or_, [(start < at(x)) & (at(x) < end) for x in (*GREY_BAND, *WHITE_BAND)])

    cut = steps(df.where(F.col(mask)).select(*keys, value), keys, value,
                {"m": F.lit(1), "_sum": F.col(value).cast("double")}, crossed, groups=groups)

    def band(share: tuple[float, float]) -> Column:
        weight = F.greatest(F.least(end, at(share[1])) - F.greatest(start, at(share[0])), F.lit(0))
        total = F.sum(weight)
        part = F.when(weight == F.col("m"), F.col("_sum")).otherwise(F.col("_vlo") * weight)
        return F.when(total > 0, F.sum(part) / F.when(total > 0, total))

    tissue = cut.groupBy(*keys).agg(band(GREY_BAND).alias("_g"), band(WHITE_BAND).alias("_w"))
    noise = df.groupBy(*keys).agg(F.stddev_pop(F.when(~F.col(mask), F.col(value).cast("double"))).alias("_s"))
    joined = combine(noise, tissue, keys, groups)
    return joined.select(*keys, _ratio(F.abs(F.col("_g") - F.col("_w")), F.col("_s")).alias("cnr"))


def entropy(df: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "value", bins: int = BINS,
            groups: int | None = None) -> DataFrame:
    """``-sum(d * log2(d))`` over histogram densities (not probabilities); may be negative."""
    hist = histogram(df, keys, value, bins, _kept, groups)
    return hist.groupBy(*keys).agg(_entropy_of(bins).alias("entropy"))


def _entropy_of(bins: int) -> Column:
    """With d = n / (N * w): sum(d * log2 d) = (sum(n * log2 n) / N - log2(N * w)) / w."""
    total, width = F.sum("n"), (F.max("hi") - F.min("lo")) / F.lit(float(bins))
    mean_log = F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / total
    return -(mean_log - F.log2(total * width)) / width


def foreground_fraction(df: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "value") -> DataFrame:
    share = F.avg((F.col(value) != 0).cast("int"))
    return samples(df.select(*keys, value), value).groupBy(*keys).agg(share.alias("foreground_fraction"))


def _base(rows: DataFrame, keys: Sequence[str], value: str, mask: str | None) -> DataFrame:
    v = F.col(value).cast("double")
    pos = F.when(_kept(v), v)
    extra = []
    if mask:
        extra = [F.bool_or(F.col(mask).isNotNull()).alias("_has"), F.avg(F.when(F.col(mask), v)).alias("_signal"),
                 F.stddev_pop(F.when(~F.col(mask), v)).alias("_noise")]
    return rows.groupBy(*keys).agg(
        F.avg((v != 0).cast("int")).alias("foreground_fraction"),
        F.avg(pos).alias("_mean"), F.stddev_pop(pos).alias("_std"),
        F.min(pos).alias("_lo"), F.max(pos).alias("_hi"),
        F.min(v).alias("min_intensity"), F.max(v).alias("max_intensity"),
        F.bool_or(F.isnan(v)).alias("has_nan"), F.bool_or(F.abs(v) == F.lit(float("inf"))).alias("has_inf"),
        F.bool_or(v < 0).alias("has_negative"), F.bool_and(v == 0).alias("is_empty"), *extra,
    )


def artifacts(df: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "value",
              groups: int | None = None) -> DataFrame:
    """Flags of a volume; ``has_outliers`` means a positive sample beyond ten population std."""
    flat = samples(df.select(*keys, value), value)
    base = cut_lineage(_base(flat, keys, value, None), "artifacts")
    v = F.col(value).cast("double")
    far = samples(attach(df.select(*keys, value), base.select(*keys, "_mean", "_std"), keys, groups), value)
    extreme = far.groupBy(*keys).agg(F.coalesce(F.bool_or(
        _kept(v) & (F.abs(v - F.col("_mean")) > F.lit(EXTREME_STD) * F.col("_std"))), F.lit(False)
    ).alias("has_outliers"))
    return combine(base, extreme, keys, groups).select(
        *keys, "has_nan", "has_inf", "has_negative", "is_empty", "has_outliers")


def qc_metrics(df: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "value",
               mask: str | None = None, volumes: DataFrame | None = None, groups: int | None = None) -> DataFrame:
    """One row of quality metrics per volume, with the columns of ``volumes`` joined in. ``mask`` is a
    boolean column of long rows; a volume where it is null has no mask and falls back to Otsu."""
    keys = list(keys)
    v = F.col(value).cast("double")
    source = df.select(*keys, value, *([mask] if mask else []))
    # both tables are small and read again below: stored, so that samples are read exactly twice
    base = cut_lineage(_base(samples(source, value), keys, value, mask), "qc-base")
    lo, hi = widened(F.col("_lo"), F.col("_hi"))
    params = base.select(*keys, lo.alias("lo"), hi.alias("hi"), "_mean", "_std")
    rows = samples(attach(df.select(*keys, value), params, keys, groups, "inner"), value).where(_kept(v))
    at = bin_of(v, F.col("lo"), F.col("hi"), BINS)
    upper = v > bin_center(at.cast("double"), F.col("lo"), F.col("hi"), BINS)

    def half(side: Column, name: str) -> list[Column]:
        x = F.when(side, v)
        return [F.count(x).alias(f"n_{name}"), F.avg(x).alias(f"m_{name}"), F.var_pop(x).alias(f"v_{name}")]

    hist = cut_lineage(rows.groupBy(*keys, at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.bool_or(F.abs(v - F.col("_mean")) > F.lit(EXTREME_STD) * F.col("_std")).alias("far"),
        *half(~upper, "low"), *half(upper, "high"),
    ), "qc-bins")
    cut = _otsu_of(hist, keys, BINS)
    # signal and background moments from the half bins, merged by the parallel variance rule
    placed = combine(hist, cut, keys, groups, "inner")
    center = bin_center(F.col("bin").cast("double"), F.col("lo"), F.col("hi"), BINS)
    below, same = center < F.col("threshold"), center == F.col("threshold")
    zero = F.lit(0.0)
    both = _weighted("low") + _weighted("high")
    agg = placed.groupBy(*keys).agg(
        F.sum(F.when(below, 0).when(same, F.col("n_high")).otherwise(F.col("n"))).alias("_ns"),
        F.sum(F.when(below, zero).when(same, _weighted("high")).otherwise(both)).alias("_ss"),
        F.sum(F.when(below, F.col("n")).when(same, F.col("n_low")).otherwise(0)).alias("_nb"),
        F.sum(F.when(below, both).when(same, _weighted("low")).otherwise(zero)).alias("_sb"),
        F.bool_or("far").alias("has_outliers"), _entropy_of(BINS).alias("entropy"),
    )
    mean_noise = F.col("_sb") / F.when(F.col("_nb") > 0, F.col("_nb"))
    around = combine(placed, agg.select(*keys, mean_noise.alias("_mb"), "_nb"), keys, groups, "inner")

    def spread(h: str) -> Column:
        return F.coalesce(F.col(f"n_{h}") * (F.col(f"v_{h}") + F.pow(F.col(f"m_{h}") - F.col("_mb"), 2)), zero)

    m2 = F.when(below, spread("low") + spread("high")).when(same, spread("low")).otherwise(zero)
    noise = around.groupBy(*keys).agg(
        F.sqrt(F.sum(m2) / F.when(F.max("_nb") > 0, F.max("_nb"))).alias("_otsu_noise"))
    joined = combine(combine(base, agg, keys, groups), noise, keys, groups)
    otsu_snr = _ratio(F.col("_ss") / F.when(F.col("_ns") > 0, F.col("_ns")), F.col("_otsu_noise"))
    nan = F.lit(float("nan"))
    out = joined.select(
        *keys,
        (F.when(F.col("_has"), _ratio(F.col("_signal"), F.col("_noise"))).otherwise(otsu_snr) if mask else otsu_snr).alias("snr"),
        F.coalesce("entropy", zero).alias("entropy"), "foreground_fraction",
        F.coalesce("_mean", zero).alias("mean_intensity"), F.coalesce("_std", zero).alias("std_intensity"),
        F.when(F.col("has_nan"), nan).otherwise(F.col("min_intensity")).alias("min_intensity"),
        "max_intensity", (F.col("_has") if mask else F.lit(False)).alias("has_mask"), "has_nan", "has_inf", "has_negative", "is_empty",
        F.coalesce("has_outliers", F.lit(False)).alias("has_outliers"),
    )
    if mask:
        out = combine(out, cnr(df, keys, value, mask, groups), keys, groups).withColumn("cnr", F.coalesce("cnr", zero))
    else:
        out = out.withColumn("cnr", zero)
    # the caller's fields may be of any width, so the planner picks this join by their size
    return combine(out, volumes, keys) if volumes is not None else out


def _weighted(half: str) -> Column:
    return F.coalesce(F.col(f"n_{half}") * F.col(f"m_{half}"), F.lit(0.0))


def outlier_reasons(qc: DataFrame, method: str = "iqr", threshold: float = 1.5, item: str = "volume_id",
                    metrics: Sequence[str] = OUTLIER_METRICS, flags: Sequence[str] = OUTLIER_FLAGS) -> DataFrame:
    """``(item, reason)`` for every metric out of bounds and every artifact flag that is set."""
    check_choice("outlier method", method, ("iqr", "zscore"))
    metrics = [m for m in metrics if m in qc.columns]
    long = unpivot(qc, metrics, [item])
    if method == "iqr":
        q = percentiles(long, ["metric"], "value", [25.0, 75.0], groups=len(metrics))
        width = threshold * (F.col("pct")[1] - F.col("pct")[0])
        limits = q.select("metric", (F.col("pct")[0] - width).alias("_a"), (F.col("pct")[1] + width).alias("_b"))
        bad = (F.col("value") < F.col("_a")) | (F.col("value") > F.col("_b"))
    else:
        limits = long.groupBy("metric").agg(F.avg("value").alias("_a"), F.stddev_pop("value").alias("_b"))
        bad = (F.col("_b") > 0) & (F.abs((F.col("value") - F.col("_a")) / F.when(F.col("_b") > 0, F.col("_b"))) > threshold)
    out = attach(long, limits, ["metric"], len(metrics)).where(bad).select(item, F.col("metric").alias("reason"))
    flags = [f for f in flags if f in qc.columns]
    if flags:
        flagged = qc.select(item, *flags).unpivot([item], flags, "reason", "_set").where("_set")
        out = out.unionByName(flagged.select(item, "reason"))
    return out


def detect_outliers(qc: DataFrame, method: str = "iqr", threshold: float = 1.5, item: str = "volume_id",
                    **kw) -> DataFrame:
    """Distinct outlier items."""
    return outlier_reasons(qc, method, threshold, item, **kw).select(item).distinct()


def flag_outliers(qc: DataFrame, outliers: DataFrame, item: str = "volume_id") -> DataFrame:
    marked = outliers.select(item).distinct().withColumn("_o", F.lit(True))
    return qc.join(marked, item, "left").withColumn("is_outlier", F.coalesce("_o", F.lit(False))).drop("_o")


def qc_summary(flagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of a flagged table; "with artifacts" counts NaN, infinite and empty volumes."""
    art = F.col("has_nan") | F.col("has_inf") | F.col("is_empty")
    return flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_volumes"), F.count_if("is_outlier").alias("n_outliers"),
        F.count_if(art).alias("n_with_artifacts"))


def qc_distributions(flagged: DataFrame, metrics: Sequence[str] = OUTLIER_METRICS, bins: int = 20,
                     item: str = "volume_id") -> DataFrame:
    """Histogram of each metric over all volumes and over the outliers."""
    long = unpivot(flagged, metrics, [item, "is_outlier"])
    rows = long.select("metric", "value", F.explode(F.when(
        F.col("is_outlier"), F.array(F.lit("all"), F.lit("outliers"))).otherwise(F.array(F.lit("all")))).alias("which"))
    return histogram(rows, ["metric", "which"], "value", bins, groups=2 * len(metrics))


def compare_stages(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "value",
                   bins: int = 100, groups: int | None = None) -> DataFrame:
    """Histograms of nonzero samples of two stages of the same volumes."""
    keep = lambda v: (v != 0) & finite(v)
    side = lambda df, name: histogram(df, keys, value, bins, keep, groups).withColumn("stage", F.lit(name))
    return side(before, "original").unionByName(side(after, "preprocessed"))


def with_mask(df: DataFrame, inside: Column, value: str = "value") -> DataFrame:
    return voxels(df, value).withColumn("in_mask", inside)
