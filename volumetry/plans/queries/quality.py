"""Quality metrics, outlier volumes and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from volumetry.operators import qc
from volumetry.plans import fixtures as fx
from volumetry.plans.queries.stats import hist_sql
from volumetry.plans.registry import query
from volumetry.schema import voxels
from volumetry.session import cut_lineage

MASKED = """m as (select *, (x between 1 and 2 and y between 1 and 2 and z between 1 and 2) as in_mask from pos)"""


def otsu_sql(src: str) -> str:
    return hist_sql("volume_id", src, 256, "where value > 0") + """,
  w as (select volume_id, bin, lo, hi, sum(n) over a as n1, sum(n*bin) over a as s1,
    sum(n) over t as n, sum(n*bin) over t as s from h
    window a as (partition by volume_id order by bin), t as (partition by volume_id)),
  vr as (select *, round(cast(n1 as double) * (n-n1) * pow(s1/n1 - (s-s1)/nullif(n-n1,0), 2), 6) as spread from w),
  ot as (select volume_id, lo + (hi-lo)*(bin+0.5)/256.0 as threshold from (select *, row_number() over
    (partition by volume_id order by spread desc, bin) as rn from vr where n > n1) q where rn = 1)"""


def masked(spark, d):
    inside = F.col("x").between(1, 2) & F.col("y").between(1, 2) & F.col("z").between(1, 2)
    return voxels(fx.packed_pos(spark, d)).withColumn("in_mask", inside)


@query("otsu", f"""with {fx.LINES}, {otsu_sql('lines')} select volume_id, threshold from ot""")
def otsu(spark, d):
    return qc.otsu(fx.line_samples(spark, d), groups=fx.supplier_count(spark, d))


SNR = """sn as (select volume_id, coalesce(avg(case when value > threshold then value end)
  / nullif(stddev_pop(case when value > 0 and value <= threshold then value end), 0), 0) as snr
  from {src} join ot using (volume_id) group by 1)"""


@query("snr_otsu", f"""with {fx.LINES}, {otsu_sql('lines')}, {SNR.format(src='lines')}
  select volume_id, round(snr, 6) as snr from sn""")
def snr_otsu(spark, d):
    out = qc.snr(fx.line_samples(spark, d), groups=fx.supplier_count(spark, d))
    return out.withColumn("snr", F.round("snr", 6))


@query("snr_masked", f"""with {fx.POS}, {MASKED}
  select volume_id, round(coalesce(avg(value) filter (where in_mask) / nullif(stddev_pop(value) filter
    (where not in_mask), 0), 0), 6) as snr from m group by 1""")
def snr_masked(spark, d):
    return qc.snr(masked(spark, d), mask="in_mask").withColumn("snr", F.round("snr", 6))


CNR = """cr as (select volume_id, value, row_number() over (partition by volume_id order by value) - 1 as r,
    count(*) over (partition by volume_id) as n from m where in_mask),
  cb as (select volume_id, avg(value) filter (where r >= floor(0.3::double*n) and r < floor(0.5::double*n)) as g,
    avg(value) filter (where r >= floor(0.7::double*n) and r < floor(0.9::double*n)) as w from cr group by 1),
  cn as (select volume_id, stddev_pop(value) as s from m where not in_mask group by 1)"""


@query("cnr", f"""with {fx.POS}, {MASKED}, {CNR}
  select volume_id, round(coalesce(abs(g-w)/nullif(s,0), 0), 6) as cnr from cb join cn using (volume_id)""")
def cnr(spark, d):
    out = qc.cnr(masked(spark, d), groups=fx.volume_count(spark, d))
    return out.withColumn("cnr", F.round("cnr", 6))


@query("cnr_lines", """with m as (select l_suppkey as volume_id, l_extendedprice as value, l_linestatus = 'F' as in_mask
    from lineitem),
  """ + CNR + """ select volume_id, round(coalesce(abs(g-w)/nullif(s,0), 0), 5) as cnr from cb join cn using (volume_id)""")
def cnr_lines(spark, d):
    from volumetry.sources.tables import table
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("volume_id"), F.col("l_extendedprice").alias("value"),
        (F.col("l_linestatus") == "F").alias("in_mask"))
    out = qc.cnr(rows, groups=fx.supplier_count(spark, d))
    return out.withColumn("cnr", F.round("cnr", 5))


ENTROPY = """en as (select volume_id, -sum(dn * log2(dn)) as entropy from (select volume_id,
  n / (sum(n) over (partition by volume_id) * ((hi-lo)/256.0)) as dn from h) q group by 1)"""


@query("entropy", f"""with {fx.POS}, {hist_sql('volume_id', 'pos', 256, 'where value > 0')}, {ENTROPY}
  select volume_id, round(entropy, 3) as entropy from en""")
def entropy(spark, d):
    out = qc.entropy(fx.packed_pos(spark, d), groups=fx.volume_count(spark, d))
    return out.withColumn("entropy", F.round("entropy", 3))


ART = """ar as (select volume_id, coalesce(bool_or(isnan(value)), false) as has_nan, bool_or(isinf(value)) as has_inf,
    bool_or(value < 0) as has_negative, bool_and(value = 0) as is_empty,
    coalesce(bool_or(value > 0 and abs(value - m) > 10 * s), false) as has_outliers
  from {src} left join (select volume_id, avg(value) as m, stddev_pop(value) as s from {src} where value > 0 group by 1)
    using (volume_id) group by volume_id)"""


@query("artifact_flags", f"with {fx.VOX}, {ART.format(src='vox')} select * from ar")
def artifact_flags(spark, d):
    return qc.artifacts(fx.packed(spark, d), groups=fx.volume_count(spark, d))


@query("foreground_fraction", f"""with {fx.POS} select volume_id, round(avg(cast(value <> 0 as int)), 9)
  as foreground_fraction from pos group by 1""")
def foreground_fraction(spark, d):
    out = qc.foreground_fraction(fx.packed_pos(spark, d))
    return out.withColumn("foreground_fraction", F.round("foreground_fraction", 9))


def qc_sql(src: str) -> str:
    return f"""{otsu_sql(src)}, {SNR.format(src=src)}, {ENTROPY}, {ART.format(src=src)},
  qb as (select volume_id, avg(cast(value <> 0 as int)) as foreground_fraction,
    coalesce(avg(value) filter (where value > 0), 0) as mean_intensity,
    coalesce(stddev_pop(value) filter (where value > 0), 0) as std_intensity,
    min(value) as min_intensity, max(value) as max_intensity from {src} group by 1),
  qc as (select qb.*, coalesce(snr, 0) as snr, cast(0 as double) as cnr, coalesce(entropy, 0) as entropy, has_nan, has_inf, has_negative,
    is_empty, has_outliers, false as has_mask from qb left join sn using (volume_id) left join en using (volume_id)
    join ar using (volume_id))"""


QC_OUT = {"snr": 5, "entropy": 3, "foreground_fraction": 6, "mean_intensity": 6, "std_intensity": 6,
          "min_intensity": 6, "max_intensity": 6, "cnr": 6}
QC_SELECT = ", ".join(f"round({c}, {n}) as {c}" for c, n in QC_OUT.items())


def _rounded(df):
    return df.withColumns({c: F.round(c, n) for c, n in QC_OUT.items()})


@query("qc_metrics", f"""with {fx.POS}, {qc_sql('pos')}
  select volume_id, {QC_SELECT}, has_mask, has_nan, has_inf, has_negative, is_empty, has_outliers, label
  from qc join embeddings e on e.vec_id = qc.volume_id""")
def qc_metrics(spark, d):
    out = qc.qc_metrics(fx.packed_pos(spark, d), volumes=fx.headers(spark, d).select("volume_id", "label"),
                        groups=fx.volume_count(spark, d))
    return _rounded(out)


@query("qc_metrics_masked", f"""with {fx.POS}, {MASKED}, {qc_sql('pos')}, {CNR},
  ms as (select volume_id, coalesce(avg(value) filter (where in_mask) / nullif(stddev_pop(value) filter
    (where not in_mask), 0), 0) as msnr from m group by 1)
  select volume_id, round(msnr, 5) as snr, round(coalesce(abs(g-w)/nullif(cn.s,0), 0), 6) as cnr,
    round(entropy, 3) as entropy, true as has_mask, has_outliers
  from qc join ms using (volume_id) join cb using (volume_id) join cn using (volume_id)""".replace("as cnr, coalesce", "as cnr0, coalesce"))
def qc_metrics_masked(spark, d):
    out = qc.qc_metrics(masked(spark, d), mask="in_mask", groups=fx.volume_count(spark, d))
    return out.select("volume_id", F.round("snr", 5).alias("snr"), F.round("cnr", 6).alias("cnr"),
                      F.round("entropy", 3).alias("entropy"), "has_mask", "has_outliers")


@query("qc_metrics_lines", f"""with {fx.LINES}, {qc_sql('lines')}
  select volume_id, round(snr,5) as snr, round(entropy,8) as entropy, round(mean_intensity,3) as mean_intensity,
    round(std_intensity,3) as std_intensity, has_outliers from qc""")
def qc_metrics_lines(spark, d):
    out = qc.qc_metrics(fx.line_samples(spark, d), groups=fx.supplier_count(spark, d))
    return out.select("volume_id", F.round("snr", 5).alias("snr"), F.round("entropy", 8).alias("entropy"),
                      F.round("mean_intensity", 3).alias("mean_intensity"),
                      F.round("std_intensity", 3).alias("std_intensity"), "has_outliers")


def _limits(method: str) -> str:
    parts = []
    for m in ("snr", "cnr", "entropy", "foreground_fraction", "mean_intensity", "std_intensity"):
        if method == "iqr":
            parts.append(f"""select volume_id, '{m}' as reason from qc, (select quantile_cont({m},0.25) as q1,
              quantile_cont({m},0.75) as q3 from qc) q where {m} < q1-1.5*(q3-q1) or {m} > q3+1.5*(q3-q1)""")
        else:
            parts.append(f"""select volume_id, '{m}' as reason from qc, (select avg({m}) as a, stddev_pop({m}) as s
              from qc) q where s > 0 and abs(({m}-a)/s) > 2.5""")
    for f in ("has_nan", "has_inf", "is_empty", "has_outliers"):
        parts.append(f"select volume_id, '{f}' from qc where {f}")
    return "rs as (" + " union all ".join(parts) + ")"


def _qc(spark, d):
    """The metric table is stored before it is judged: outlier rules read it several times."""
    return cut_lineage(qc.qc_metrics(fx.packed(spark, d), groups=fx.volume_count(spark, d)))


@query("outliers_iqr", f"with {fx.VOX}, {qc_sql('vox')}, {_limits('iqr')} select volume_id, reason from rs")
def outliers_iqr(spark, d):
    return qc.outlier_reasons(_qc(spark, d), "iqr", 1.5)


@query("outliers_zscore", f"with {fx.VOX}, {qc_sql('vox')}, {_limits('z')} select volume_id, reason from rs")
def outliers_zscore(spark, d):
    return qc.outlier_reasons(_qc(spark, d), "zscore", 2.5)


@query("outliers_all", f"""with {fx.VOX}, {qc_sql('vox')}, {_limits('iqr')}
  select distinct volume_id from rs order by volume_id""")
def outliers_all(spark, d):
    return qc.detect_outliers(_qc(spark, d)).orderBy("volume_id")


@query("qc_summary", f"""with {fx.VOX}, {qc_sql('vox')}, {_limits('iqr')}
  select e.label, count(*) as total_volumes, count(*) filter (where volume_id in (select volume_id from rs)) as n_outliers,
    count(*) filter (where has_nan or has_inf or is_empty) as n_with_artifacts
  from qc join embeddings e on e.vec_id = qc.volume_id group by 1""")
def qc_summary(spark, d):
    table = _qc(spark, d)
    flagged = qc.flag_outliers(table, qc.detect_outliers(table))
    return qc.qc_summary(flagged.join(fx.headers(spark, d).select("volume_id", "label"), "volume_id"), ["label"])


def _dist_sql() -> str:
    parts = []
    for m in qc.OUTLIER_METRICS:
        for which, w in (("all", ""), ("outliers", "where volume_id in (select volume_id from rs)")):
            parts.append(f"""select '{m}' as metric, '{which}' as which, cast(least(floor((v-lo)/(hi-lo)*20), 19) as int) as bin,
              count(*) as n from (select {m} as v from qc {w}) a, (select case when min({m})=max({m}) then min({m})-0.5
              else min({m}) end as lo, case when min({m})=max({m}) then max({m})+0.5 else max({m}) end as hi
              from qc {w}) b group by 3""")
    return " union all ".join(parts)


@query("qc_distributions", f"with {fx.LINES}, {qc_sql('lines')}, {_limits('iqr')} {_dist_sql()}")
def qc_distributions(spark, d):
    table = cut_lineage(qc.qc_metrics(fx.line_samples(spark, d), groups=fx.supplier_count(spark, d)))
    flagged = qc.flag_outliers(table, qc.detect_outliers(table))
    out = qc.qc_distributions(flagged)
    return out.select("metric", "which", "bin", "n")


@query("compare_stages", f"""with {fx.POS}, cl as (select volume_id, least(value, 0.1::double) as value from pos),
  {hist_sql('volume_id', 'pos', 100, 'where value <> 0')},
  cb as (select volume_id, min(value) as mn, max(value) as mx from cl where value <> 0 group by 1),
  cw as (select volume_id, case when mn=mx then mn-0.5 else mn end as lo, case when mn=mx then mx+0.5 else mx end as hi from cb)
  select 'original' as stage, volume_id, bin, n from h
  union all select 'preprocessed', volume_id, cast(least(floor((value-lo)/(hi-lo)*100), 99) as int), count(*)
  from cl join cw using (volume_id) where value <> 0 group by 2, 3""")
def compare_stages(spark, d):
    before = fx.packed_pos(spark, d)
    after = before.withColumn("value", F.transform("value", lambda v: F.least(v.cast("double"), F.lit(0.1))))
    out = qc.compare_stages(before, after, groups=fx.volume_count(spark, d))
    return out.select("stage", "volume_id", "bin", "n")
