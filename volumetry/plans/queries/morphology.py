"""Masks, morphology and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from volumetry.operators import bitmasks, masks
from volumetry.plans import fixtures as fx
from volumetry.plans.registry import query
from volumetry.schema import positive, voxels

THRESH = """th as (select volume_id, quantile_cont(value, 0.1) as t from pos where value > 0 group by 1),
  tm as (select volume_id, x, y, z, coalesce(value > t, false) as in_mask from pos left join th using (volume_id)),
  st as (select volume_id, x, y, z from tm where in_mask)"""
OFF = """o as (select * from (values (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(dx,dy,dz))"""


def foreground(spark, d):
    return voxels(fx.packed(spark, d)).where(positive(F.col("value"))).select("volume_id", "x", "y", "z")


@query("threshold_mask", f"with {fx.POS}, {THRESH} select volume_id, x, y, z, in_mask from tm")
def threshold_mask(spark, d):
    return masks.threshold_mask(fx.packed_pos(spark, d), groups=fx.volume_count(spark, d)).drop("value")


@query("apply_mask", f"""with {fx.POS}, {THRESH} select volume_id, x, y, z, round(case when in_mask then value else 0 end, 6) as value
  from pos join tm using (volume_id, x, y, z)""")
def apply_mask(spark, d):
    df = fx.packed_pos(spark, d)
    inside = masks.threshold_mask(df, groups=fx.volume_count(spark, d)).where("in_mask")
    return masks.apply_mask(df, inside).withColumn("value", F.round("value", 6))


@query("apply_mask_bricks", f"""with {fx.POS}, {fx.CAT}, pairs as (select a.volume_id as input_id, b.volume_id as target_id
    from cat a join cat b on a.subject = b.subject and a.modality = b.modality and a.session = 'ses-1' and b.session = 'ses-2')
  select p.volume_id, p.x, p.y, p.z, round(case when m.value > 0 then p.value else 0 end, 6) as value
  from pairs join pos p on p.volume_id = input_id join pos m on m.volume_id = target_id and m.x = p.x and m.y = p.y and m.z = p.z""")
def apply_mask_bricks(spark, d):
    """Each first session masked by the positive part of the second, brick by brick."""
    from volumetry.plans.queries.pairs import pairs
    df, found = fx.packed_pos(spark, d), pairs(spark, d)
    mine = df.join(found.select(F.col("input_id").alias("volume_id")), "volume_id")
    other = df.join(found.select(F.col("target_id").alias("volume_id"), "input_id"), "volume_id").drop("volume_id")
    out = voxels(masks.apply_mask(mine, other.withColumnRenamed("input_id", "volume_id")))
    return out.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("mask_erode", f"""with {fx.VOX}, st as (select volume_id, x, y, z from vox where value > -0.15), {OFF}
  select volume_id, cast(x+dx as int) as x, cast(y+dy as int) as y, cast(z+dz as int) as z from st, o group by all having count(*) = 7""")
def mask_erode(spark, d):
    rows = voxels(fx.packed(spark, d)).where(F.col("value") > -0.15).select("volume_id", "x", "y", "z")
    return masks.erode(rows)


@query("mask_dilate", f"""with {fx.VOX}, st as (select volume_id, x, y, z from vox where value > 0.2), {OFF},
  a as (select distinct volume_id, x+dx as x, y+dy as y, z+dz as z from st, o where x+dx between 0 and 3
    and y+dy between 0 and 3 and z+dz between 0 and 3)
  select distinct volume_id, cast(x+dx as int) as x, cast(y+dy as int) as y, cast(z+dz as int) as z from a, o
  where x+dx between 0 and 3 and y+dy between 0 and 3 and z+dz between 0 and 3""")
def mask_dilate(spark, d):
    rows = voxels(fx.packed(spark, d)).where(F.col("value") > 0.2).select("volume_id", "x", "y", "z")
    return masks.dilate(rows, fx.headers(spark, d), 2, groups=fx.volume_count(spark, d))


COMP = """lb as (select volume_id, (x*4+y)*4+z as p, x, y, z from {src}),
  rc as (select volume_id, p as label, p, x, y, z from lb
    union select n.volume_id, r.label, n.p, n.x, n.y, n.z from rc r join lb n on n.volume_id = r.volume_id
      and abs(n.x-r.x)+abs(n.y-r.y)+abs(n.z-r.z) = 1),
  cp as (select volume_id, x, y, z, min(label) as label from rc group by 1, 2, 3, 4)"""
FG = "fg as (select volume_id, x, y, z from vox where value > 0)"


@query("components", f"""with recursive {fx.VOX}, {FG}, {COMP.format(src='fg')}
  select volume_id, count(distinct label) as n_components, count(*) as n_voxels from cp group by 1""")
def components(spark, d):
    labelled = masks.components(foreground(spark, d))
    return labelled.groupBy("volume_id").agg(
        F.countDistinct("label").alias("n_components"), F.sum(F.col("z1") - F.col("z0") + 1).alias("n_voxels"))


@query("largest_component", f"""with recursive {fx.VOX}, {FG}, {COMP.format(src='fg')},
  sz as (select volume_id, label, row_number() over (partition by volume_id order by count(*) desc, label) as rn from cp group by 1, 2)
  select cp.volume_id, x, y, z from cp join sz using (volume_id, label) where rn = 1""")
def largest_component(spark, d):
    return masks.largest_component(foreground(spark, d))


@query("fill_holes", f"""with recursive {fx.VOX}, bg as (select volume_id, x, y, z from vox where value <= -0.15),
  op as (select volume_id, x, y, z from bg where x in (0,3) or y in (0,3) or z in (0,3)
    union select n.volume_id, n.x, n.y, n.z from op r join bg n on n.volume_id = r.volume_id
      and abs(n.x-r.x)+abs(n.y-r.y)+abs(n.z-r.z) = 1)
  select volume_id, x, y, z from vox v where not exists (select 1 from op where op.volume_id = v.volume_id
    and op.x = v.x and op.y = v.y and op.z = v.z)""")
def fill_holes(spark, d):
    dense = voxels(fx.packed(spark, d)).withColumn("in_mask", F.col("value") > -0.15)
    return masks.fill_holes(dense, fx.headers(spark, d), groups=fx.volume_count(spark, d))


BRAIN = f"""bg as (select volume_id, x, y, z from tm where not in_mask),
  op as (select volume_id, x, y, z from bg where x in (0,3) or y in (0,3) or z in (0,3)
    union select n.volume_id, n.x, n.y, n.z from op r join bg n on n.volume_id = r.volume_id
      and abs(n.x-r.x)+abs(n.y-r.y)+abs(n.z-r.z) = 1),
  fl as (select volume_id, x, y, z from tm anti join op using (volume_id, x, y, z)), {OFF},
  er as (select volume_id, x+dx as x, y+dy as y, z+dz as z from fl, o group by all having count(*) = 7),
  d1 as (select distinct volume_id, x+dx as x, y+dy as y, z+dz as z from er, o where x+dx between 0 and 3
    and y+dy between 0 and 3 and z+dz between 0 and 3),
  d2 as (select distinct volume_id, x+dx as x, y+dy as y, z+dz as z from d1, o where x+dx between 0 and 3
    and y+dy between 0 and 3 and z+dz between 0 and 3), {COMP.format(src='d2')},
  sz as (select volume_id, label, row_number() over (partition by volume_id order by count(*) desc, label) as rn from cp group by 1, 2),
  bm as (select cp.volume_id, x, y, z from cp join sz using (volume_id, label) where rn = 1)"""


def lifted(spark, d):
    """Samples shifted up, so that masks survive an erosion on the small grid."""
    return fx.packed(spark, d).withColumn("value", F.transform(
        "value", lambda v: F.greatest(v.cast("double") + F.lit(0.3), F.lit(0.0))))


LIFT = fx.VOX + ", pos as (select volume_id, x, y, z, greatest(value + 0.3::double, 0) as value from vox)"


@query("simple_mask", f"with recursive {LIFT}, {THRESH}, {BRAIN} select volume_id, cast(x as int) as x, cast(y as int) as y, cast(z as int) as z from bm")
def simple_mask(spark, d):
    return masks.simple_mask(lifted(spark, d), fx.headers(spark, d), groups=fx.volume_count(spark, d))


@query("skull_strip", f"""with recursive {LIFT}, {THRESH}, {BRAIN}
  select p.volume_id, p.x, p.y, p.z, round(case when bm.x is null then 0 else value end, 6) as value
  from pos p left join bm on bm.volume_id = p.volume_id and bm.x = p.x and bm.y = p.y and bm.z = p.z""")
def skull_strip(spark, d):
    out = masks.skull_strip(lifted(spark, d), fx.headers(spark, d), groups=fx.volume_count(spark, d))
    return out.withColumn("value", F.round("value", 6))


def wide_bits(spark, d, cut: float):
    return bitmasks.above(fx.wide(spark, d), F.lit(cut))


def on_wide(spark, d) -> dict:
    """The arguments that operators on the volumes of many bricks share."""
    return {"volumes": fx.wide_headers(spark, d), "groups": fx.volume_count(spark, d), "side": fx.SIDE}


SPREAD = """{out} as (select distinct s.volume_id, s.x+dx as x, s.y+dy as y, s.z+dz as z, s.n from {src} s, o
    where s.x+dx between 0 and n-1 and s.y+dy between 0 and n-1 and s.z+dz between 0 and n-1)"""


@query("mask_open_wide", f"""with {fx.VOXW}, st as (select volume_id, x, y, z, n from vox where value > -0.2), {OFF},
  e1 as (select volume_id, x+dx as x, y+dy as y, z+dz as z, n from st, o group by all having count(*) = 7),
  {SPREAD.format(out='d1', src='e1')}, {SPREAD.format(out='d2', src='d1')}
  select volume_id, cast(x as int) as x, cast(y as int) as y, cast(z as int) as z from d2""")
def mask_open_wide(spark, d):
    """One erosion and two dilations of volumes of many bricks, in one exchange."""
    return bitmasks.set_voxels(bitmasks.morph(wide_bits(spark, d, -0.2), steps=[("erode", 1), ("dilate", 2)], **on_wide(spark, d)))


WFLOOD = """bg as (select volume_id, x, y, z, n from vox where value <= {cut}),
  op as (select volume_id, x, y, z from bg where x in (0,n-1) or y in (0,n-1) or z in (0,n-1)
    union select n.volume_id, n.x, n.y, n.z from op r join bg n on n.volume_id = r.volume_id
      and abs(n.x-r.x)+abs(n.y-r.y)+abs(n.z-r.z) = 1)"""


@query("fill_holes_wide", f"""with recursive {fx.VOXW}, {WFLOOD.format(cut=-0.05)}
  select volume_id, x, y, z from vox v where not exists (select 1 from op where op.volume_id = v.volume_id
    and op.x = v.x and op.y = v.y and op.z = v.z)""")
def fill_holes_wide(spark, d):
    return bitmasks.set_voxels(bitmasks.filled(wide_bits(spark, d, -0.05), **on_wide(spark, d)))


WCOMP = """fg as (select volume_id, (x*n+y)*n+z as p, x, y, z from vox where value > 0.12),
  rc as (select volume_id, p as label, p, x, y, z from fg
    union select n.volume_id, r.label, n.p, n.x, n.y, n.z from rc r join fg n on n.volume_id = r.volume_id
      and abs(n.x-r.x)+abs(n.y-r.y)+abs(n.z-r.z) = 1),
  cp as (select volume_id, x, y, z, min(label) as label from rc group by 1, 2, 3, 4)"""


@query("components_wide", f"""with recursive {fx.VOXW}, {WCOMP}, s as (select volume_id, label, count(*) as n from cp group by 1, 2)
  select volume_id, count(*) as n_components, cast(sum(n) as bigint) as n_voxels, max(n) as n_largest from s group by 1""")
def components_wide(spark, d):
    parts = bitmasks.components(wide_bits(spark, d, 0.12), **on_wide(spark, d))
    whole = parts.groupBy("volume_id", "label").agg(F.sum("n").alias("n"))
    return whole.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n_components"), F.sum("n").alias("n_voxels"), F.max("n").alias("n_largest"))


@query("largest_component_wide", f"""with recursive {fx.VOXW}, {WCOMP},
  sz as (select volume_id, label, row_number() over (partition by volume_id order by count(*) desc, label) as rn from cp group by 1, 2)
  select cp.volume_id, x, y, z from cp join sz using (volume_id, label) where rn = 1""")
def largest_component_wide(spark, d):
    return bitmasks.set_voxels(bitmasks.largest(wide_bits(spark, d, 0.12), **on_wide(spark, d)))


@query("simple_mask_bricks", f"with recursive {LIFT}, {THRESH}, {BRAIN} select volume_id, cast(x as int) as x, cast(y as int) as y, cast(z as int) as z from bm")
def simple_mask_bricks(spark, d):
    return bitmasks.set_voxels(bitmasks.simple(lifted(spark, d), fx.headers(spark, d), groups=fx.volume_count(spark, d)))
