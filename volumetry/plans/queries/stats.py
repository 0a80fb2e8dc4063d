"""Counts, moments, percentiles and histograms over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from volumetry.operators import ordering, stats
from volumetry.plans import fixtures as fx
from volumetry.plans.registry import query
from volumetry.schema import voxels
from volumetry.sources.tables import table


def rounded(df, digits: int, *columns: str):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("volume_stats", f"""with {fx.VOX}
  select volume_id, count(*) as n, round(avg(value),6) as mean, round(stddev_pop(value),6) as std,
    round(min(value),6) as min, round(max(value),6) as max, round(median(value),6) as median,
    round(quantile_cont(value, 0.01),6) as p01, round(quantile_cont(value, 0.99),6) as p99
  from vox where value <> 0 group by volume_id""")
def volume_stats(spark, d):
    out = stats.volume_stats(fx.packed(spark, d), groups=fx.volume_count(spark, d))
    return rounded(out, 6, "mean", "std", "min", "max", "median", "p01", "p99")


@query("volume_moments", f"""with {fx.LINES}
  select volume_id, count(*) as n, round(avg(value),4) as mean, round(stddev_pop(value),4) as std,
    min(value) as min, max(value) as max from lines group by volume_id""")
def volume_moments(spark, d):
    return rounded(stats.moments(fx.line_samples(spark, d), ["volume_id"]), 4, "mean", "std")


@query("percentiles", f"""with {fx.LINES}
  select field_strength, count(*) as n, round(quantile_cont(value, 0.005),6) as p005,
    round(quantile_cont(value, 0.01),6) as p01, round(median(value),6) as p50,
    round(quantile_cont(value, 0.99),6) as p99, round(quantile_cont(value, 0.995),6) as p995
  from lines group by field_strength""")
def percentiles(spark, d):
    ps = {"p005": 0.5, "p01": 1.0, "p50": 50.0, "p99": 99.0, "p995": 99.5}
    out = ordering.percentiles(fx.line_samples(spark, d), ["field_strength"], "value", list(ps.values()))
    return out.select("field_strength", "n", *[F.round(F.col("pct")[i], 6).alias(k) for i, k in enumerate(ps)])


@query("percentiles_per_volume", f"""with {fx.LINES}
  select volume_id, count(*) as n, round(quantile_cont(value, 0.01),6) as p01,
    round(median(value),6) as p50, round(quantile_cont(value, 0.99),6) as p99
  from lines group by volume_id""")
def percentiles_per_volume(spark, d):
    out = ordering.percentiles(fx.line_samples(spark, d), ["volume_id"], "value", [1.0, 50.0, 99.0],
                               groups=fx.supplier_count(spark, d))
    return out.select("volume_id", "n", *[F.round(F.col("pct")[i], 6).alias(k)
                                          for i, k in enumerate(("p01", "p50", "p99"))])


@query("cohort_stats", f"""with {fx.CAT}, {fx.VOX}
  select c.field_strength, count(*) as n, count(distinct v.volume_id) as n_volumes,
    round(avg(value),6) as mean, round(stddev_pop(value),6) as std, round(min(value),6) as min,
    round(max(value),6) as max, round(median(value),6) as median,
    round(quantile_cont(value,0.01),6) as p01, round(quantile_cont(value,0.99),6) as p99
  from vox v join cat c using (volume_id) where value <> 0 group by c.field_strength""")
def cohort_stats(spark, d):
    labelled = fx.packed(spark, d).join(
        fx.catalog(spark, d).select("volume_id", "field_strength"), "volume_id")
    out = stats.cohort_stats(labelled, ["field_strength"])
    return rounded(out, 6, "mean", "std", "min", "max", "median", "p01", "p99")


@query("cohort_stats_modality", f"""with {fx.CAT}, {fx.VOX}
  select c.modality, count(*) as n, count(distinct v.volume_id) as n_volumes,
    round(avg(value),6) as mean, round(stddev_pop(value),6) as std, round(median(value),6) as median
  from vox v join cat c using (volume_id) where value <> 0 group by c.modality""")
def cohort_stats_modality(spark, d):
    labelled = fx.packed(spark, d).join(fx.catalog(spark, d).select("volume_id", "modality"), "volume_id")
    out = stats.cohort_stats(labelled, ["modality"]).select("modality", "n", "n_volumes", "mean", "std", "median")
    return rounded(out, 6, "mean", "std", "median")


@query("shape_census", """select label, '4x4x4' as grid, count(*) as n_volumes from embeddings group by label""")
def shape_census(spark, d):
    return stats.shape_census(fx.headers(spark, d), ["label"])


@query("value_counts", """select event_type, extract(day from ts) as day, count(*) as n from events group by 1, 2""")
def value_counts(spark, d):
    days = table(spark, d, "events").select("event_type", F.dayofmonth("ts").cast("long").alias("day"))
    return stats.value_counts(days, "event_type", "day")


COLUMNS = ("subject", "session", "modality", "field_strength")


@query("inventory", f"with {fx.CAT} " + " union all ".join(
    f"select '{c}' as \"column\", {c} as entry, count(*) as n from cat group by {c}" for c in COLUMNS))
def inventory(spark, d):
    return stats.inventory(fx.catalog(spark, d), *COLUMNS)


@query("distinct_counts", f"with {fx.CAT} " + " union all ".join(
    f"select '{c}' as \"column\", count(distinct {c}) as n_distinct from cat" for c in COLUMNS))
def distinct_counts(spark, d):
    return stats.distinct_counts(fx.catalog(spark, d), *COLUMNS)


NATIONS = range(25)


@query("crosstab", "select c_mktsegment, " + ", ".join(
    f'count(*) filter (where c_nationkey = {n}) as "{n}"' for n in NATIONS) + " from customer group by c_mktsegment")
def crosstab(spark, d):
    return stats.crosstab(table(spark, d, "customer"), "c_mktsegment", "c_nationkey", list(NATIONS))


@query("crosstab_sessions", f"""with {fx.CAT}
  select subject, count(*) filter (where session='ses-1') as "ses-1",
    count(*) filter (where session='ses-2') as "ses-2" from cat group by subject""")
def crosstab_sessions(spark, d):
    return stats.crosstab(fx.catalog(spark, d), "subject", "session", ["ses-1", "ses-2"])


HIST = """b as (select {k}, min(value) as mn, max(value) as mx from {src} {w} group by {k}),
  wide as (select {k}, case when mn=mx then mn-0.5 else mn end as lo,
    case when mn=mx then mx+0.5 else mx end as hi from b),
  h as (select {k}, cast(least(floor((value-lo)/(hi-lo)*{n}), {n}-1) as int) as bin, count(*) as n,
    min(lo) as lo, max(hi) as hi from {src} join wide using ({k}) {w} group by 1, 2)"""


def hist_sql(key: str, src: str, n: int, where: str = "") -> str:
    return HIST.format(k=key, src=src, n=n, w=where)


@query("histogram", f"""with {fx.EVENTS}, {hist_sql('field_strength', 'ev', 50)}
  select field_strength, bin, n, lo, hi from h""")
def histogram(spark, d):
    return stats.histogram(fx.event_samples(spark, d), ["field_strength"], n=50)


@query("histogram_density", f"""with {fx.LINES}, {hist_sql('volume_id', 'lines', 100)}
  select volume_id, bin, n, round(n / (sum(n) over (partition by volume_id) * ((hi-lo)/100.0)), 12) as density
  from h""")
def histogram_density(spark, d):
    hist = stats.histogram(fx.line_samples(spark, d), ["volume_id"], n=100, groups=fx.supplier_count(spark, d))
    out = stats.density(hist, ["volume_id"], 100)
    return out.select("volume_id", "bin", "n", F.round("density", 12).alias("density"))


@query("histogram_cdf", f"""with {fx.LINES}, {hist_sql('field_strength', 'lines', 256)},
  g as (select field_strength, lo, hi, cast(unnest(range(256)) as int) as bin from wide),
  f as (select field_strength, bin, coalesce(h.n, 0) as n, g.lo, g.hi from g left join h using (field_strength, bin))
  select field_strength, bin, n, lo + (hi-lo)*bin/256.0 as left_edge,
    round(sum(n) over (partition by field_strength order by bin) / sum(n) over (partition by field_strength), 9) as cdf
  from f""")
def histogram_cdf(spark, d):
    hist = stats.histogram(fx.line_samples(spark, d), ["field_strength"], n=256, dense=True)
    out = stats.cdf(hist, ["field_strength"], 256)
    return out.withColumn("cdf", F.round("cdf", 9))


@query("batch_stats", """select label as batch, count(*) as n, round(avg(v),6) as mean,
  round(stddev_pop(v),6) as std, round(min(v),6) as min, round(max(v),6) as max
  from (select label, cast(unnest(embedding) as double) as v from embeddings) q group by label""")
def batch_stats(spark, d):
    df = table(spark, d, "embeddings").select(F.col("label").alias("batch"), F.col("embedding").alias("value"))
    return rounded(stats.batch_stats(df, ["batch"]), 6, "mean", "std", "min", "max")


@query("boxplot_stats", f"""with {fx.EVENTS},
  q as (select field_strength, quantile_cont(value,0.25) as q1, median(value) as median,
    quantile_cont(value,0.75) as q3 from ev where value <> 0 group by field_strength)
  select field_strength, round(min(q1),6) as q1, round(min(median),6) as median, round(min(q3),6) as q3,
    round(least(min(case when value >= q1-1.5*(q3-q1) then value end), min(q1)),6) as whisker_low,
    round(greatest(max(case when value <= q3+1.5*(q3-q1) then value end), max(q3)),6) as whisker_high,
    count(case when value < q1-1.5*(q3-q1) or value > q3+1.5*(q3-q1) then 1 end) as n_outside
  from ev join q using (field_strength) where value <> 0 group by field_strength""")
def boxplot_stats(spark, d):
    out = stats.boxplot_stats(fx.event_samples(spark, d), ["field_strength"])
    return rounded(out, 6, "q1", "median", "q3", "whisker_low", "whisker_high")


def _describe_sql(cols, src):
    return " union all ".join(
        f"select '{c}' as metric, count({c}) as count, round(avg({c}),4) as mean, "
        f"round(stddev_samp({c}),4) as std, round(min({c}),4) as min, round(quantile_cont({c},0.25),4) as q25, "
        f"round(median({c}),4) as q50, round(quantile_cont({c},0.75),4) as q75, round(max({c}),4) as max "
        f"from {src}" for c in cols)


LINE_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_metrics", _describe_sql(LINE_METRICS, "lineitem"))
def describe_metrics(spark, d):
    out = stats.describe_exact(table(spark, d, "lineitem"), LINE_METRICS)
    return rounded(out, 4, "mean", "std", "min", "q25", "q50", "q75", "max")


@query("hash_md5", "select doc_id, md5(text) as digest from documents")
def hash_md5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))


@query("foreground_rows", f"""with {fx.VOX} select volume_id, x, y, z, round(value, 6) as value from vox where value > 0""")
def foreground_rows(spark, d):
    from volumetry.schema import positive
    out = voxels(fx.packed(spark, d)).where(positive(F.col("value")))
    return out.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("hash_sample", f"""with {fx.EVENTS}
  select user_id, event_id, value from (select user_id, event_id, value, row_number() over (
    partition by user_id order by md5(concat('7|', cast(event_id as varchar))), event_id) as rn
    from events) q where rn <= 20""")
def hash_sample(spark, d):
    from volumetry.functions.hashing import digest
    ev = table(spark, d, "events").select("user_id", "event_id", "value")
    return ordering.hash_sample(ev, digest(7, F.col("event_id")), ["event_id"], 20, ["user_id"])
