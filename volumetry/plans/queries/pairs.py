"""Scores of volume pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from volumetry.operators import catalog, evaluate, tiles
from volumetry.plans import fixtures as fx
from volumetry.plans.registry import query


def pairs(spark, d):
    found = catalog.paired(catalog.pair_sessions(fx.catalog(spark, d), "ses-1", "ses-2", item="volume_id"))
    return found.select(F.col("input").alias("pair_id"), F.col("input").alias("input_id"), F.col("target").alias("target_id"))


def packed_pairs(spark, d):
    return evaluate.pair_bricks(pairs(spark, d), fx.packed(spark, d), n_pairs=fx.volume_count(spark, d))


def generated(a, b):
    return (a + b) / 2


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("paired_voxels", f"with {fx.PAIRS} select pair_id, x, y, z, round(a,6) as a, round(b,6) as b from pv")
def paired_voxels(spark, d):
    return rounded(evaluate.pair_voxels(packed_pairs(spark, d)), 6, "a", "b")


METRICS = """pm as (select pair_id, count(*) as n, avg(abs(a-b)) as l1, avg(pow(a-b,2)) as mse,
  max(b)-min(b) as r from pv group by 1)"""


@query("pair_l1", f"with {fx.PAIRS}, {METRICS} select pair_id, round(l1, 6) as l1 from pm")
def pair_l1(spark, d):
    return rounded(evaluate.pair_metrics(packed_pairs(spark, d)), 6, "l1").select("pair_id", "l1")


@query("pair_mse", f"with {fx.PAIRS}, {METRICS} select pair_id, n, round(mse, 8) as mse from pm")
def pair_mse(spark, d):
    return rounded(evaluate.pair_metrics(packed_pairs(spark, d)), 8, "mse").select("pair_id", "n", "mse")


@query("pair_psnr", f"with {fx.PAIRS}, {METRICS} select pair_id, round(10*log10(r*r/mse), 6) as psnr from pm")
def pair_psnr(spark, d):
    return rounded(evaluate.pair_metrics(packed_pairs(spark, d)), 6, "psnr").select("pair_id", "psnr")


@query("batch_psnr", f"""with {fx.PAIRS}, bm as (select e.label, pair_id, avg(pow(a-b,2)) as mse from pv
    join embeddings e on e.vec_id = pv.pair_id group by 1, 2)
  select label, round(avg(case when mse > 0 then 20*log10(1/sqrt(mse)) else 0 end), 6) as psnr, count(*) as n_batches
  from bm group by 1""")
def batch_psnr(spark, d):
    labels = fx.headers(spark, d).select(F.col("volume_id").alias("pair_id"), "label")
    rows = packed_pairs(spark, d).join(labels, "pair_id")
    return rounded(evaluate.batch_psnr(rows, ["pair_id"], ["label"]), 6, "psnr")


@query("pair_psnr_norm", f"""with {fx.PAIRS}, e as (select pair_id, min(a) as a0, max(a) as a1, min(b) as b0, max(b) as b1
    from pv group by 1)
  select pair_id, round(10*log10(1/avg(pow((a-a0)/(a1-a0+1e-8)-(b-b0)/(b1-b0+1e-8), 2))), 6) as psnr
  from pv join e using (pair_id) group by 1""")
def pair_psnr_norm(spark, d):
    out = evaluate.normalized_metrics(packed_pairs(spark, d), groups=fx.volume_count(spark, d))
    return rounded(out, 6, "psnr").select("pair_id", "psnr")


def ssim_sql(other: str, name: str) -> str:
    return f"""{name} as (select pair_id, avg(((2*ux*uy+c1)*(2*vxy+c2))/((ux*ux+uy*uy+c1)*(vx+vy+c2))) as s from (
    select pair_id, ux, uy, 27/26.0*(uxx-ux*ux) as vx, 27/26.0*(uyy-uy*uy) as vy, 27/26.0*(uxy-ux*uy) as vxy,
      pow(0.01*r,2) as c1, pow(0.03*r,2) as c2
    from (select c.pair_id, c.x, c.y, c.z, avg({other}) as ux, avg(n.b) as uy, avg({other}*{other}) as uxx,
        avg(n.b*n.b) as uyy, avg({other}*n.b) as uxy
      from (select distinct pair_id, x, y, z from pv where x between 1 and 2 and y between 1 and 2 and z between 1 and 2) c
      join pv n on n.pair_id = c.pair_id and abs(n.x-c.x) <= 1 and abs(n.y-c.y) <= 1 and abs(n.z-c.z) <= 1
      group by all) w join pm using (pair_id)) q group by 1)"""


@query("pair_ssim", f"with {fx.PAIRS}, {METRICS}, {ssim_sql('n.a', 'sa')} select pair_id, round(s, 6) as ssim from sa")
def pair_ssim(spark, d):
    out = evaluate.ssim(packed_pairs(spark, d), win=3, groups=fx.volume_count(spark, d))
    return out.select("pair_id", F.round("ssim_a", 6).alias("ssim"))


@query("pair_ssim_small_grid", f"""with {fx.PAIRS} select distinct pair_id, cast(null as double) as ssim from pv""")
def pair_ssim_small_grid(spark, d):
    """The default window does not fit into the grid: no value."""
    out = evaluate.ssim(packed_pairs(spark, d), win=7, groups=fx.volume_count(spark, d))
    return out.select("pair_id", F.col("ssim_a").alias("ssim"))


GEN = f"""{METRICS}, gm as (select pair_id, avg(abs((a+b)/2-b)) as l1g, avg(pow((a+b)/2-b,2)) as mseg from pv group by 1),
  {ssim_sql('n.a', 'sa')}, {ssim_sql('((n.a+n.b)/2)', 'sg')},
  ev as (select pair_id, 10*log10(r*r/mse) as psnr_input, 10*log10(r*r/mseg) as psnr_generated,
    10*log10(r*r/mseg) - 10*log10(r*r/mse) as psnr_improvement, sa.s as ssim_input, sg.s as ssim_generated,
    sg.s - sa.s as ssim_improvement, l1 as l1_input, l1g as l1_generated
  from pm join gm using (pair_id) join sa using (pair_id) join sg using (pair_id))"""
EVAL = ("psnr_input", "psnr_generated", "psnr_improvement", "ssim_input", "ssim_generated", "ssim_improvement",
        "l1_input", "l1_generated")


def evaluated(spark, d):
    return evaluate.evaluate(packed_pairs(spark, d), generated, win=3, groups=fx.volume_count(spark, d))


@query("eval_improvement", f"with {fx.PAIRS}, {GEN} select pair_id, " + ", ".join(f"round({c},6) as {c}" for c in EVAL) + " from ev")
def eval_improvement(spark, d):
    return rounded(evaluated(spark, d), 6, *EVAL)


@query("eval_aggregate", f"with {fx.PAIRS}, {GEN} " + " union all ".join(
    f"""select '{c}' as metric, round(avg({c}),5) as mean, round(stddev_samp({c}),5) as std, round(min({c}),5) as min,
    round(max({c}),5) as max from ev""" for c in EVAL))
def eval_aggregate(spark, d):
    return rounded(evaluate.eval_aggregate(evaluated(spark, d), EVAL), 5, "mean", "std", "min", "max")


@query("eval_verdict", f"""with {fx.PAIRS}, {GEN} select pair_id, case when psnr_generated > 25 and ssim_generated > 0.85
  then 'good' else 'needs work' end as verdict from ev""")
def eval_verdict(spark, d):
    return evaluate.verdict(evaluated(spark, d), "psnr_generated", "ssim_generated").select("pair_id", "verdict")


CHECKS = """cb as (select pair_id, min(a) as a_min, max(a) as a_max, avg(a) as a_mean, stddev_pop(a) as a_std,
    min(b) as b_min, max(b) as b_max, avg(b) as b_mean, stddev_pop(b) as b_std from pv group by 1),
  co as (select pair_id, avg(cast(abs(a-a_mean) > 3*a_std as int)) as a_outlier_ratio,
    avg(cast(abs(b-b_mean) > 3*b_std as int)) as b_outlier_ratio,
    avg(cast(a = a_min as int) + cast(a = a_max as int)) as saturation_ratio from pv join cb using (pair_id) group by 1)"""
KS = """un as (select pair_id, a as v, 1 as na, 0 as nb from pv union all select pair_id, b, 0, 1 from pv),
  st as (select pair_id, abs(sum(na) over w / sum(na) over t - sum(nb) over w / sum(nb) over t) as gap,
    sum(na) over t as m, sum(nb) over t as n from (select pair_id, v, sum(na) as na, sum(nb) as nb from un group by 1, 2) q
    window w as (partition by pair_id order by v), t as (partition by pair_id)),
  k1 as (select pair_id, max(gap) as ks, sqrt(max(m)*max(n)/(max(m)+max(n)))*max(gap) as lam from st group by 1),
  ks as (select pair_id, ks as ks_statistic, case when lam < 0.2 then 1.0 else least(greatest((select
    sum((case when k % 2 = 1 then 2.0 else -2.0 end) * exp(-2.0*k*k*lam*lam)) from (select unnest(range(1, 101)) as k) kk),
    0.0), 1.0) end as ks_pvalue from k1)"""
SIDES = [f"{c}_{m}" for c in ("a", "b") for m in ("min", "max", "mean", "std", "outlier_ratio")] + ["saturation_ratio"]


@query("consistency", f"with {fx.PAIRS}, {CHECKS} select pair_id, " + ", ".join(
    f"round({c}, 6) as {c}" for c in SIDES) + " from cb join co using (pair_id)")
def consistency(spark, d):
    return rounded(evaluate.consistency(packed_pairs(spark, d), groups=fx.volume_count(spark, d)), 6, *SIDES)


@query("ks_stat", f"with {fx.PAIRS}, {KS} select pair_id, round(ks_statistic, 9) as ks_statistic, round(ks_pvalue, 6) as ks_pvalue from ks")
def ks_stat(spark, d):
    out = evaluate.ks_2samp(packed_pairs(spark, d), groups=fx.volume_count(spark, d))
    return out.withColumns({"ks_statistic": F.round("ks_statistic", 9), "ks_pvalue": F.round("ks_pvalue", 6)})


@query("consistency_warnings", f"""with {fx.PAIRS}, {CHECKS}, {KS} select pair_id, true as shape_match,
    concat_ws(',', case when a_outlier_ratio > 0.01 then 'outliers' end, case when saturation_ratio > 0.1 then 'saturation' end,
    case when ks_pvalue < 0.01 then 'distribution' end) as warnings from co join ks using (pair_id)""")
def consistency_warnings(spark, d):
    packed, n = packed_pairs(spark, d), fx.volume_count(spark, d)
    checks = evaluate.consistency(packed, groups=n).join(evaluate.ks_2samp(packed, groups=n), "pair_id").join(
        evaluate.shape_check(pairs(spark, d), fx.headers(spark, d)).select("pair_id", "shape_match"), "pair_id")
    out = evaluate.consistency_warnings(checks)
    return out.select("pair_id", "shape_match", F.array_join("warnings", ",").alias("warnings"))


@query("eval_histograms", f"""with {fx.PAIRS}, r as (select pair_id, 'input' as role, a as v from pv union all
    select pair_id, 'target', b from pv union all select pair_id, 'generated', (a+b)/2 from pv),
  e as (select pair_id, role, min(v) as lo, max(v) as hi, avg(v) as mean, stddev_pop(v) as std from r group by 1, 2)
  select pair_id, role, cast(least(floor((v-lo)/(hi-lo)*100), 99) as int) as bin, count(*) as n,
    round(max(mean),6) as mean, round(max(std),6) as std from r join e using (pair_id, role) group by 1, 2, 3""")
def eval_histograms(spark, d):
    hist, stats = evaluate.eval_histograms(packed_pairs(spark, d), generated, groups=fx.volume_count(spark, d))
    return rounded(hist.join(stats, ["pair_id", "role"]).drop("lo", "hi"), 6, "mean", "std")


UNEVEN = "(p.target_id % 6 <> 1)"  # the fixture cuts a plane from these targets


@query("pair_unequal_grids", f"""with {fx.PAIRS}, {METRICS}, {ssim_sql('n.a', 'sa')}
  select p.pair_id, {UNEVEN} as shape_match, case when {UNEVEN} then n else 0 end as n,
    case when {UNEVEN} then round(l1, 6) end as l1, case when {UNEVEN} then round(10*log10(r*r/mse), 6) end as psnr,
    case when {UNEVEN} then round(s, 6) end as ssim
  from pairs p join pm using (pair_id) join sa using (pair_id)""")
def pair_unequal_grids(spark, d):
    """Pairs of different grids stay, without scores."""
    packed = evaluate.pair_bricks(pairs(spark, d), fx.uneven(spark, d), n_pairs=fx.volume_count(spark, d))
    out = evaluate.pair_metrics(packed).join(evaluate.ssim(packed, win=3, groups=fx.volume_count(spark, d)), "pair_id")
    return rounded(out.withColumnRenamed("ssim_a", "ssim"), 6, "l1", "psnr", "ssim").select(
        "pair_id", "shape_match", "n", "l1", "psnr", "ssim")


@query("batch_psnr_unequal", f"""with {fx.PAIRS}, bm as (select p.pair_id, e.label, {UNEVEN} as whole, avg(pow(a-b,2)) as mse from pairs p join pv using (pair_id)
    join embeddings e on e.vec_id = p.pair_id group by 1, 2, 3)
  select label, round(avg(case when whole then case when mse > 0 then 20*log10(1/sqrt(mse)) else 0 end end), 6) as psnr,
    count(case when whole then 1 end) as n_batches from bm group by 1""")
def batch_psnr_unequal(spark, d):
    """Batches of different grids have no score."""
    labels = fx.headers(spark, d).select(F.col("volume_id").alias("pair_id"), "label")
    rows = evaluate.pair_bricks(pairs(spark, d), fx.uneven(spark, d), n_pairs=fx.volume_count(spark, d)).join(labels, "pair_id")
    return rounded(evaluate.batch_psnr(rows, ["pair_id"], ["label"]), 6, "psnr")


@query("consistency_unequal_grids", f"""with {fx.PAIRS}, ub as (select pair_id, target_id, min(b.value) as b_min, max(b.value) as b_max,
    avg(b.value) as b_mean, count(*) as n from pairs p join vox b on b.volume_id = p.target_id and ({UNEVEN} or b.z < 3) group by 1, 2),
  ua as (select pair_id, min(value) as a_min, max(value) as a_max, avg(value) as a_mean from pairs join vox on volume_id = input_id group by 1)
  select pair_id, {UNEVEN} as shape_match, case when {UNEVEN} then '' else 'shape_mismatch' end as warning, round(a_min, 6) as a_min,
    round(a_max, 6) as a_max, round(a_mean, 6) as a_mean, round(b_min, 6) as b_min, round(b_max, 6) as b_max,
    round(b_mean, 6) as b_mean from ub p join ua using (pair_id)""")
def consistency_unequal_grids(spark, d):
    """Statistics of each side over all of its own samples, and the warning of its grid."""
    n = fx.volume_count(spark, d)
    packed = evaluate.pair_bricks(pairs(spark, d), fx.uneven(spark, d), n_pairs=n)
    shapes = evaluate.shape_check(pairs(spark, d), fx.uneven_headers(spark, d)).select("pair_id", "shape_match")
    found = evaluate.consistency(packed, groups=n).join(evaluate.ks_2samp(packed, groups=n), "pair_id").join(shapes, "pair_id")
    first = F.array_join(F.filter("warnings", lambda w: w == "shape_mismatch"), ",")
    columns = ("a_min", "a_max", "a_mean", "b_min", "b_max", "b_mean")
    return rounded(evaluate.consistency_warnings(found), 6, *columns).select("pair_id", "shape_match", first.alias("warning"), *columns)


@query("pair_ssim_nan", f"""with {fx.PAIRS}, {METRICS}, {ssim_sql('n.a', 'sa')} select pair_id, pair_id % 6 = 0 as undefined,
  case when pair_id % 6 <> 0 then round(s, 6) end as ssim from sa""")
def pair_ssim_nan(spark, d):
    """One NaN sample makes the similarity of its pair NaN."""
    hole = F.transform("value", lambda v, i: F.when(
        (F.col("volume_id") % 6 == 0) & (i == 21), F.lit(float("nan"))).otherwise(v.cast("double")))
    volumes = fx.packed(spark, d).withColumn("value", hole)
    packed = evaluate.pair_bricks(pairs(spark, d), volumes, n_pairs=fx.volume_count(spark, d))
    out = evaluate.ssim(packed, win=3, groups=fx.volume_count(spark, d))
    bad = F.isnan("ssim_a")
    return out.select("pair_id", bad.alias("undefined"), F.when(~bad, F.round("ssim_a", 6)).alias("ssim"))


@query("pair_ssim_norm", f"""with {fx.PAIRS.replace("pv as (", "raw as (")}, e as (select pair_id, min(a) as a0, max(a) as a1,
    min(b) as b0, max(b) as b1 from raw group by 1),
  pv as (select pair_id, x, y, z, (a-a0)/(a1-a0+1e-8) as a, (b-b0)/(b1-b0+1e-8) as b from raw join e using (pair_id)),
  pm as (select pair_id, 1.0::double as r from e), {ssim_sql('n.a', 'sa')} select pair_id, round(s, 6) as ssim from sa""")
def pair_ssim_norm(spark, d):
    out = evaluate.normalized_ssim(packed_pairs(spark, d), win=3, groups=fx.volume_count(spark, d))
    return out.select("pair_id", F.round("ssim_a", 6).alias("ssim"))


@query("eval_generated", f"""with {fx.PAIRS}, {METRICS}, m as (select pair_id, avg(a) as mu from pv where x < 3 and y < 3 and z < 3 group by 1),
  pg as (select pv.*, case when x < 3 and y < 3 and z < 3 then a * 2 - mu else a end as g from pv join m using (pair_id)),
  gm as (select pair_id, avg(abs(g-b)) as l1g, avg(pow(g-b,2)) as mseg from pg group by 1),
  {ssim_sql('n.a', 'sa')}, {ssim_sql('n.g', 'sg').replace('join pv n', 'join pg n')},
  ev as (select pair_id, 10*log10(r*r/mse) as psnr_input, 10*log10(r*r/mseg) as psnr_generated,
    10*log10(r*r/mseg) - 10*log10(r*r/mse) as psnr_improvement, sa.s as ssim_input, sg.s as ssim_generated,
    sg.s - sa.s as ssim_improvement, l1 as l1_input, l1g as l1_generated
  from pm join gm using (pair_id) join sa using (pair_id) join sg using (pair_id))
  select pair_id, """ + ", ".join(f"round({c},6) as {c}" for c in EVAL) + " from ev")
def eval_generated(spark, d):
    """The volumes that a model made, tile by tile, scored against input and target."""
    n = fx.volume_count(spark, d)
    made = tiles.tiled_model(fx.packed(spark, d), fx.headers(spark, d), lambda cube: cube * 2 - cube.mean(), (3, 3, 3), 0.0, groups=n)
    packed = evaluate.pair_bricks(pairs(spark, d), fx.packed(spark, d), n_pairs=n, generated=made)
    return rounded(evaluate.evaluate(packed, win=3, groups=n), 6, *EVAL)
