"""Normalisation, display windows and harmonisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from volumetry.operators import harmonize, normalize
from volumetry.plans import fixtures as fx
from volumetry.plans.registry import query
from volumetry.session import scratch_path

LIMITS = """q as (select volume_id, quantile_cont(value,0.005) as lo, quantile_cont(value,0.995) as hi
  from {src} where value > 0 group by 1),
  c as (select s.*, case when lo is null then value else greatest(least(value, hi), lo) end as cv
    from {src} s left join q using (volume_id))"""


@query("clip_percentile", f"""with {fx.POS}, {LIMITS.format(src='pos')}
  select volume_id, x, y, z, round(cv, 6) as value from c""")
def clip_percentile(spark, d):
    out = normalize.clip_percentile(fx.packed_pos(spark, d), groups=fx.volume_count(spark, d))
    return out.withColumn("value", F.round("value", 6))


def _norm(spark, d, method):
    out = normalize.normalize(fx.packed_pos(spark, d), method=method, groups=fx.volume_count(spark, d))
    return out.withColumn("value", F.round("value", 6))


@query("normalize_zscore", f"""with {fx.POS}, {LIMITS.format(src='pos')},
  s as (select volume_id, avg(cv) as m, stddev_pop(cv) as sd from c where cv > 0 group by 1)
  select volume_id, x, y, z, round(case when sd > 0 then (cv - m) / sd else cv end, 6) as value
  from c left join s using (volume_id)""")
def normalize_zscore(spark, d):
    return _norm(spark, d, "zscore")


@query("normalize_minmax", f"""with {fx.POS}, {LIMITS.format(src='pos')},
  s as (select volume_id, min(cv) as a, max(cv) as b from c where cv > 0 group by 1)
  select volume_id, x, y, z, round(case when b > a then (cv - a) / (b - a) else cv end, 6) as value
  from c left join s using (volume_id)""")
def normalize_minmax(spark, d):
    return _norm(spark, d, "minmax")


@query("normalize_percentile", f"""with {fx.POS}, {LIMITS.format(src='pos')},
  s as (select volume_id, quantile_cont(cv, 0.01) as a, quantile_cont(cv, 0.99) as b from c where cv > 0 group by 1)
  select volume_id, x, y, z, round(case when b > a then greatest(least((cv - a) / (b - a), 1), 0) else cv end, 6)
    as value from c left join s using (volume_id)""")
def normalize_percentile(spark, d):
    return _norm(spark, d, "percentile")


@query("normalize_zscore_masked", f"""with {fx.POS},
  m as (select *, (x between 1 and 2 and y between 1 and 2 and z between 1 and 2) as in_mask from pos),
  q as (select volume_id, quantile_cont(value,0.005) as lo, quantile_cont(value,0.995) as hi from m
    where in_mask group by 1),
  c as (select m.*, greatest(least(value, hi), lo) as cv from m join q using (volume_id)),
  s as (select volume_id, avg(cv) as mu, stddev_pop(cv) as sd from c where in_mask group by 1)
  select volume_id, x, y, z, round(case when sd > 0 then (cv - mu) / sd else cv end, 6) as value
  from c join s using (volume_id)""")
def normalize_zscore_masked(spark, d):
    from volumetry.schema import voxels
    inside = F.col("x").between(1, 2) & F.col("y").between(1, 2) & F.col("z").between(1, 2)
    rows = voxels(fx.packed_pos(spark, d)).withColumn("in_mask", inside)
    out = normalize.normalize(rows, mask="in_mask", groups=fx.volume_count(spark, d))
    return out.withColumn("value", F.round("value", 6)).drop("in_mask")


@query("normalize_lines", f"""with {fx.LINES}, {LIMITS.format(src='lines')},
  s as (select volume_id, avg(cv) as m, stddev_pop(cv) as sd from c where cv > 0 group by 1)
  select volume_id, field_strength, count(*) as n, round(avg((cv - m) / sd), 5) as mean,
    round(min((cv - m) / sd), 5) as min, round(max((cv - m) / sd), 5) as max
  from c join s using (volume_id) group by 1, 2""")
def normalize_lines(spark, d):
    out = normalize.normalize(fx.line_samples(spark, d), groups=fx.supplier_count(spark, d))
    return out.groupBy("volume_id", "field_strength").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 5).alias("mean"),
        F.round(F.min("value"), 5).alias("min"), F.round(F.max("value"), 5).alias("max"))


@query("minmax_eps", f"""with {fx.VOX}, s as (select volume_id, min(value) as a, max(value) as b from vox group by 1)
  select volume_id, x, y, z, round((value - a) / (b - a + 1e-8), 6) as value from vox join s using (volume_id)""")
def minmax_eps(spark, d):
    out = normalize.minmax_eps(fx.packed(spark, d), groups=fx.volume_count(spark, d))
    return out.withColumn("value", F.round("value", 6))


@query("display_window", f"""with {fx.POS}, w as (select volume_id, quantile_cont(value,0.01) as a,
    quantile_cont(value,0.99) as b from pos where value <> 0 group by 1)
  select volume_id, round(min(value),6) as min, round(max(value),6) as max, round(min(a),6) as window_low,
    round(min(b),6) as window_high from pos left join w using (volume_id) group by volume_id""")
def display_window(spark, d):
    out = normalize.display_window(fx.packed_pos(spark, d), groups=fx.volume_count(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("min", "max", "window_low", "window_high")})


ZFIT = """zf as (select field_strength, avg(value) as mean, case when stddev_pop(value) = 0 then 1
  else stddev_pop(value) end as std from lines where value > 0 group by 1)"""


@query("zscore_harmonize_fit", f"""with {fx.LINES}, {ZFIT}
  select field_strength, round(mean,4) as mean, round(std,4) as std from zf""")
def zscore_harmonize_fit(spark, d):
    model = harmonize.HarmonizerModel("zscore", "A").fit(fx.line_samples(spark, d))
    return model.table.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("zscore_harmonize", f"""with {fx.CAT}, {fx.POS},
  lv as (select v.*, field_strength from pos v join cat using (volume_id)),
  zf as (select field_strength, avg(value) as mean, stddev_pop(value) as std from lv where value > 0 group by 1)
  select volume_id, field_strength, x, y, z, round(case when value > 0 then (value-mean)/std else value end, 6)
    as value from lv join zf using (field_strength)""")
def zscore_harmonize(spark, d):
    rows = fx.packed_pos(spark, d).join(fx.catalog(spark, d).select("volume_id", "field_strength"), "volume_id")
    out = harmonize.HarmonizerModel("zscore", "3T").fit(rows).transform(rows)
    return out.withColumn("value", F.round("value", 6))


QS = "[" + ", ".join(f"{i}/99.0" for i in range(100)) + "]"
QFIT = f"""qf as (select field_strength, quantile_cont(value, {QS}) as vals from lines where value > 0 group by 1)"""


@query("quantile_fit", f"""with {fx.LINES}, {QFIT}
  select field_strength, cast(generate_subscripts(vals, 1) as int) - 1 as point, round(unnest(vals), 3) as val from qf""")
def quantile_fit(spark, d):
    model = harmonize.HarmonizerModel("quantile", "A").fit(fx.line_samples(spark, d))
    return model.table.select("field_strength", F.posexplode("vals").alias("point", "val")).withColumn(
        "val", F.round("val", 3))


@query("quantile_harmonize", f"""with ln as (select l_orderkey, l_linenumber, l_partkey, l_suppkey as volume_id,
    l_returnflag as field_strength, l_extendedprice as value from lineitem),
  lines as (select * from ln), {QFIT},
  st as (select field_strength, generate_subscripts(vals,1)-1 as j, unnest(vals) as x0 from qf),
  s1 as (select *, lead(x0) over (partition by field_strength order by j) as x1 from st),
  rf as (select j, x0 as y0, lead(x0) over (order by j) as y1 from st where field_strength = 'A'),
  seg as (select field_strength, x0, x1, y0, y1 from s1 join rf using (j) where x1 > x0),
  e as (select field_strength, vals[1] as mn, vals[100] as mx from qf),
  r as (select vals[1] as rmn, vals[100] as rmx from qf where field_strength = 'A')
  select l_orderkey, l_linenumber, l_partkey, volume_id, l.field_strength, round(case when value < mn then rmn
    when value >= mx then rmx else y0 + (value-x0)/(x1-x0)*(y1-y0) end, 3) as value
  from ln l join e using (field_strength) cross join r left join seg on seg.field_strength = l.field_strength
    and value >= x0 and value < x1""")
def quantile_harmonize(spark, d):
    from volumetry.sources.tables import table
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("volume_id"),
        F.col("l_returnflag").alias("field_strength"), F.col("l_extendedprice").alias("value"))
    out = harmonize.HarmonizerModel("quantile", "A").fit(rows).transform(rows)
    return out.withColumn("value", F.round("value", 3))


HFIT = """rb as (select min(value) as lo, max(value) as hi from {src} where value > 0 and field_strength = 'A'),
  rh as (select cast(least(floor((value-lo)/(hi-lo)*256), 255) as int) as bin, count(*) as n from {src}, rb
    where value > 0 and field_strength = 'A' group by 1),
  rd as (select bin, coalesce(n, 0) as n, lo + (hi-lo)*bin/256.0 as left_edge
    from (select cast(unnest(range(256)) as int) as bin) g left join rh using (bin) cross join rb),
  rc as (select bin, left_edge, sum(n) over (order by bin) / sum(n) over () as cdf from rd)"""


@query("hist_fit", f"""with {fx.LINES}, {HFIT.format(src='lines')}
  select 'A' as field_strength, bin, left_edge, round(cdf, 9) as cdf from rc""")
def hist_fit(spark, d):
    model = harmonize.HarmonizerModel("histogram", "A").fit(fx.line_samples(spark, d))
    return model.table.withColumn("cdf", F.round("cdf", 9))


@query("hist_match", f"""with {fx.LINES}, {HFIT.format(src='lines')},
  o as (select * from lines where field_strength <> 'A'),
  b as (select volume_id, field_strength, min(value) as lo, max(value) as hi from o group by 1, 2),
  h as (select volume_id, field_strength, cast(least(floor((value-lo)/(hi-lo)*256), 255) as int) as bin, count(*) as n
    from o join b using (volume_id, field_strength) group by 1, 2, 3),
  dn as (select b.volume_id, b.field_strength, g.bin, coalesce(n, 0) as n, lo + (hi-lo)*g.bin/256.0 as edge
    from b cross join (select cast(unnest(range(256)) as int) as bin) g
    left join h on h.volume_id = b.volume_id and h.field_strength = b.field_strength and h.bin = g.bin),
  sc as (select *, sum(n) over (partition by volume_id, field_strength order by bin)
    / sum(n) over (partition by volume_id, field_strength) as c from dn),
  pl as (select s.volume_id, s.field_strength, r.bin as i, r.cdf as x,
    least(greatest(count(*) filter (where s.c < r.cdf), 1), 255) as idx from sc s cross join rc r group by all),
  mt as (select p.volume_id, p.field_strength, p.i, l.edge + (x - l.c) * (u.edge - l.edge) / nullif(u.c - l.c, 0) as m
    from pl p join sc l on l.volume_id = p.volume_id and l.field_strength = p.field_strength and l.bin = p.idx - 1
    join sc u on u.volume_id = p.volume_id and u.field_strength = p.field_strength and u.bin = p.idx),
  nv as (select o.volume_id, o.field_strength, y0.m + (o.value - lo - seg*(hi-lo)/256.0) / ((hi-lo)/256.0) * (y1.m - y0.m) as v
    from (select o.*, lo, hi, least(floor((value-lo)/((hi-lo)/256.0)), 254) as seg
      from o join b using (volume_id, field_strength)) o
    join mt y0 on y0.volume_id = o.volume_id and y0.field_strength = o.field_strength and y0.i = seg
    join mt y1 on y1.volume_id = o.volume_id and y1.field_strength = o.field_strength and y1.i = seg + 1
    union all select volume_id, field_strength, value from lines where field_strength = 'A')
  select volume_id, field_strength, count(*) as n, count(v) as n_valid, round(avg(v), 2) as mean, round(min(v), 2) as min,
    round(max(v), 2) as max from nv group by 1, 2""")
def hist_match(spark, d):
    rows = fx.line_samples(spark, d)
    model = harmonize.HarmonizerModel("histogram", "A").fit(rows)
    out = model.transform(rows, keys=["volume_id", "field_strength"])
    return out.groupBy("volume_id", "field_strength").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_valid"), F.round(F.avg("value"), 2).alias("mean"),
        F.round(F.min("value"), 2).alias("min"), F.round(F.max("value"), 2).alias("max"))


@query("harmonize_report", f"""with {fx.LINES}, {ZFIT}
  select 'before' as stage, field_strength, round(avg(value),4) as mean, count(*) as n from lines where value > 0
    group by 2
  union all select 'after', field_strength, round(avg((value-mean)/std),4), count(*) from lines
    join zf using (field_strength) where (value-mean)/std > 0 group by 2""")
def harmonize_report(spark, d):
    rows = fx.line_samples(spark, d)
    after = harmonize.HarmonizerModel("zscore", "A").fit(rows).transform(rows)
    out = harmonize.harmonize_report({"before": rows, "after": after}, ["field_strength"])
    return out.withColumn("mean", F.round("mean", 4))


@query("harmonize_model_roundtrip", f"""with {fx.LINES}, {ZFIT}
  select field_strength, round(mean,4) as mean, round(std,4) as std from zf""")
def harmonize_model_roundtrip(spark, d):
    path = scratch_path(spark, "harmonizer")
    harmonize.HarmonizerModel("zscore", "A").fit(fx.line_samples(spark, d)).save(path)
    model = harmonize.HarmonizerModel.load(spark, path)
    return model.table.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})
