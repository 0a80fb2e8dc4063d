"""Tiles, patches, slices and grid changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from volumetry.operators import evaluate, grid, tiles
from volumetry.plans import fixtures as fx
from volumetry.plans.queries.pairs import packed_pairs
from volumetry.plans.registry import query
from volumetry.schema import voxels

TILES = """s as (select cast(unnest([0, 1]) as int) as s)"""
VOXT = fx.VOX + """, s as (select cast(unnest([0, 1]) as int) as s), tm as (select v.*, a.s as x0, b.s as y0, c.s as z0 from vox v
  join s a on v.x >= a.s and v.x < a.s+3 join s b on v.y >= b.s and v.y < b.s+3 join s c on v.z >= c.s and v.z < c.s+3)"""


@query("tile_grid", f"""with {TILES} select vec_id as volume_id, a.s as x0, b.s as y0, c.s as z0
  from embeddings, s a, s b, s c""")
def tile_grid(spark, d):
    return tiles.tile_grid(fx.headers(spark, d), (3, 3, 3), 0.5)


@query("tile_coverage", f"""with {VOXT} select volume_id, cast(count(distinct (x0,y0,z0)) as int) as n_tiles,
  cast(64 - count(distinct (x,y,z)) as bigint) as n_uncovered, cast(8 as int) as max_cover, count(*) as n_memberships
  from tm group by 1""")
def tile_coverage(spark, d):
    return tiles.tile_coverage(fx.packed(spark, d), fx.headers(spark, d), (3, 3, 3), 0.5, groups=fx.volume_count(spark, d))


@query("tile_coverage_gaps", """select vec_id as volume_id, cast(1 as int) as n_tiles, cast(37 as bigint) as n_uncovered,
  cast(1 as int) as max_cover, cast(27 as bigint) as n_memberships from embeddings""")
def tile_coverage_gaps(spark, d):
    """No tail tile: without overlap one tile of side 3 leaves the far faces uncovered."""
    return tiles.tile_coverage(fx.packed(spark, d), fx.headers(spark, d), (3, 3, 3), 0.0, groups=fx.volume_count(spark, d))


@query("tiled_identity", f"with {fx.VOX} select volume_id, x, y, z, round(value, 6) as value from vox")
def tiled_identity(spark, d):
    out = tiles.tiled_apply(fx.packed(spark, d), fx.headers(spark, d), tiles.identity, (3, 3, 3), 0.5,
                            groups=fx.volume_count(spark, d))
    return out.withColumn("value", F.round("value", 6))


@query("tiled_demean", f"""with {VOXT}, dm as (select *, value - avg(value) over (partition by volume_id, x0, y0, z0) as dv from tm)
  select volume_id, x, y, z, round(avg(dv), 6) as value from dm group by 1, 2, 3, 4""")
def tiled_demean(spark, d):
    out = tiles.tiled_apply(fx.packed(spark, d), fx.headers(spark, d), tiles.demean(), (3, 3, 3), 0.5,
                            groups=fx.volume_count(spark, d))
    return out.withColumn("value", F.round("value", 6))


@query("tiled_model", f"""with {fx.VOX}, m as (select volume_id, avg(value) as mu from vox where x < 3 and y < 3 and z < 3 group by 1)
  select volume_id, x, y, z, round(case when x < 3 and y < 3 and z < 3 then value * 2 - mu else value end, 6) as value
  from vox join m using (volume_id)""")
def tiled_model(spark, d):
    """A model on whole tiles in Python; samples outside every tile keep their input."""
    bricks = tiles.tiled_model(fx.packed(spark, d), fx.headers(spark, d), lambda cube: cube * 2 - cube.mean(), (3, 3, 3), 0.0,
                               groups=fx.volume_count(spark, d))
    out = voxels(bricks)
    return out.withColumn("value", F.round("value", 6))


def u(*parts: str) -> str:
    """SQL of a seeded draw in [0, 1)."""
    text = " , '|', ".join(f"cast({p} as varchar)" for p in parts)
    return f"(cast(concat('0x', substr(md5(concat({text})),1,8)) as bigint) / 4294967296.0)"


ORIGINS = fx.PAIRS + """, og as (select pair_id, k as patch, """ + ", ".join(
    f"cast(floor({u('42', 'pair_id', 'k', repr(c))} * 3.0) as int) as {c}0" for c in "xyz") + """
  from pairs, (select cast(unnest(range(5)) as int) as k) q)"""


def origins(spark, d):
    from volumetry.plans.queries.pairs import pairs
    shaped = pairs(spark, d).join(fx.headers(spark, d).select(F.col("volume_id").alias("pair_id"), "shape"), "pair_id")
    return tiles.patch_origins(shaped, (2, 2, 2), 5).select("pair_id", "patch", "x0", "y0", "z0")


@query("patch_origins", f"with {ORIGINS} select pair_id, patch, x0, y0, z0 from og")
def patch_origins(spark, d):
    return origins(spark, d)


@query("patch_extract", f"""with {ORIGINS} select pair_id, patch, x-x0 as dx, y-y0 as dy, z-z0 as dz, round(a,6) as a, round(b,6) as b
  from og join pv using (pair_id) where x between x0 and x0+1 and y between y0 and y0+1 and z between z0 and z0+1""")
def patch_extract(spark, d):
    out = tiles.extract_patches(origins(spark, d), evaluate.pair_voxels(packed_pairs(spark, d)), (2, 2, 2))
    return out.withColumns({c: F.round(c, 6) for c in ("a", "b")})


@query("patch_arrays", f"""with {ORIGINS}, px as (select pair_id, patch, x, y, z, a, b from og join pv using (pair_id)
    where x between x0 and x0+1 and y between y0 and y0+1 and z between z0 and z0+1)
  select pair_id, patch, count(*) as n, round(sum(a), 5) as a, round(sum(b), 5) as b from px group by 1, 2""")
def patch_arrays(spark, d):
    rows = tiles.extract_patches(origins(spark, d), evaluate.pair_voxels(packed_pairs(spark, d)), (2, 2, 2))
    packed = tiles.pack_patches(rows)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), 5)
    return packed.select("pair_id", "patch", F.size("a").cast("long").alias("n"), total("a").alias("a"), total("b").alias("b"))


@query("patch_padded", f"""with {fx.PAIRS}, g as (select cast(unnest(range(5)) as int) as i)
  select p.pair_id, cast(0 as int) as patch, gx.i as dx, gy.i as dy, gz.i as dz, round(coalesce(a,0),6) as a, round(coalesce(b,0),6) as b
  from pairs p, g gx, g gy, g gz left join pv on pv.pair_id = p.pair_id and pv.x = gx.i and pv.y = gy.i and pv.z = gz.i
  """.replace("from pairs p, g gx, g gy, g gz left join", "from (select p.pair_id, gx.i as a1, gy.i as b1, gz.i as c1 from pairs p, g gx, g gy, g gz) p left join")
  .replace("gx.i as dx, gy.i as dy, gz.i as dz", "a1 as dx, b1 as dy, c1 as dz").replace("pv.x = gx.i and pv.y = gy.i and pv.z = gz.i", "pv.x = a1 and pv.y = b1 and pv.z = c1"))
def patch_padded(spark, d):
    from volumetry.plans.queries.pairs import pairs
    shaped = pairs(spark, d).join(fx.headers(spark, d).select(F.col("volume_id").alias("pair_id"), "shape"), "pair_id")
    start = tiles.patch_origins(shaped, (5, 5, 5), 1, pad=True)
    out = tiles.extract_patches(start, evaluate.pair_voxels(packed_pairs(spark, d)), (5, 5, 5), pad=True)
    return out.withColumns({c: F.round(c, 6) for c in ("a", "b")})


@query("mid_slices", f"""with {fx.VOX} select volume_id, 'sagittal' as plane, x, y, z, round(value,6) as value from vox where x = 2
  union all select volume_id, 'coronal', x, y, z, round(value,6) from vox where y = 2
  union all select volume_id, 'axial', x, y, z, round(value,6) from vox where z = 2""")
def mid_slices(spark, d):
    out = grid.mid_slices(fx.packed(spark, d), fx.headers(spark, d), groups=fx.volume_count(spark, d))
    return out.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("scale_slice", f"""with {fx.VOX}, sl as (select volume_id, 'sagittal' as plane, x, y, z, value from vox where x = 2
  union all select volume_id, 'coronal', x, y, z, value from vox where y = 2
  union all select volume_id, 'axial', x, y, z, value from vox where z = 2),
  e as (select volume_id, plane, min(value) as lo, max(value) as hi from sl group by 1, 2)
  select volume_id, plane, x, y, z, round(case when hi > lo then (value-lo)/(hi-lo) else value end, 6) as value
  from sl join e using (volume_id, plane)""")
def scale_slice(spark, d):
    from volumetry.operators.normalize import scale_slice as scale
    slices = grid.mid_slices(fx.packed(spark, d), fx.headers(spark, d), groups=fx.volume_count(spark, d))
    return scale(slices, ["volume_id", "plane"]).withColumn("value", F.round("value", 6))


def turned(spark, d):
    """Headers with an affine that depends on the label: LAS or PSR axes."""
    row = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    las = F.array(row(-1, 0, 0, 3), row(0, 1, 0, 0), row(0, 0, 1, 0), row(0, 0, 0, 1))
    psr = F.array(row(0, 0, 1, 0), row(-1, 0, 0, 3), row(0, 1, 0, 0), row(0, 0, 0, 1))
    heads = fx.headers(spark, d).withColumn("affine", F.when(F.col("label") < 5, las).otherwise(psr))
    return grid.orientation(heads)


@query("orientation", """select vec_id as volume_id, case when label < 5 then 'LAS' else 'PSR' end as orientation from embeddings""")
def orientation(spark, d):
    return turned(spark, d).select("volume_id", "orientation")


@query("reorient_flip", f"""with {fx.VOX} select volume_id, case when label < 5 then 3 - x else z end as x,
  case when label < 5 then y else 3 - x end as y, case when label < 5 then z else y end as z, round(value, 6) as value
  from vox join embeddings on vec_id = volume_id""")
def reorient_flip(spark, d):
    out, _ = grid.reorient(fx.packed(spark, d), turned(spark, d), "RAS", groups=fx.volume_count(spark, d))
    return out.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("reorient_headers", """select vec_id as volume_id, 'RAS' as orientation, 'RAS' as again, 0 as shift from embeddings""")
def reorient_headers(spark, d):
    """The turned affine reads as the target orientation again and keeps the corner at 0."""
    _, heads = grid.reorient(fx.packed(spark, d), turned(spark, d), "RAS", groups=fx.volume_count(spark, d))
    again = grid.orientation(heads.withColumnRenamed("orientation", "first"))
    return again.select("volume_id", F.col("first").alias("orientation"), F.col("orientation").alias("again"),
                        (F.col("affine")[0][3] + F.col("affine")[1][3] + F.col("affine")[2][3]).cast("int").alias("shift"))


SPACE = (0.75, 1.0, 1.5)


@query("resample_nearest", f"""with {fx.VOX}, t as (select i::int as i, 'x' as ax, least(i*0.75, 3) as p from (select unnest(range(5)) as i) q
    union all select i::int, 'y', least(i*1.0, 3) from (select unnest(range(4)) as i) q
    union all select i::int, 'z', least(i*1.5, 3) from (select unnest(range(3)) as i) q)
  select volume_id, a.i as x, b.i as y, c.i as z, round(value, 6) as value
  from vox join t a on a.ax='x' and floor(a.p+0.5) = vox.x join t b on b.ax='y' and floor(b.p+0.5) = vox.y
  join t c on c.ax='z' and floor(c.p+0.5) = vox.z""")
def resample_nearest(spark, d):
    out, _ = grid.resample(fx.packed(spark, d), fx.headers(spark, d), SPACE, "nearest", groups=fx.volume_count(spark, d))
    return out.withColumn("value", F.round("value", 6))


@query("resample_trilinear", f"""with {fx.VOX}, t as (select i::int as i, 'x' as ax, least(i*0.75, 3) as p from (select unnest(range(5)) as i) q
    union all select i::int, 'y', least(i*1.0, 3) from (select unnest(range(4)) as i) q
    union all select i::int, 'z', least(i*1.5, 3) from (select unnest(range(3)) as i) q)
  select volume_id, a.i as x, b.i as y, c.i as z,
    round(sum(value * (1-abs(a.p-vox.x)) * (1-abs(b.p-vox.y)) * (1-abs(c.p-vox.z))), 6) as value
  from vox join t a on a.ax='x' and abs(a.p-vox.x) < 1 join t b on b.ax='y' and abs(b.p-vox.y) < 1
  join t c on c.ax='z' and abs(c.p-vox.z) < 1 group by 1, 2, 3, 4""")
def resample_trilinear(spark, d):
    out, _ = grid.resample(fx.packed(spark, d), fx.headers(spark, d), SPACE, "trilinear", groups=fx.volume_count(spark, d))
    return out.withColumn("value", F.round("value", 6))


@query("pad_crop", f"""with {fx.VOX}, g as (select vec_id as volume_id, a.i::int as x, b.i::int as y, c.i::int as z from embeddings,
    (select unnest(range(6)) as i) a, (select unnest(range(3)) as i) b, (select unnest(range(5)) as i) c)
  select g.volume_id, g.x, g.y, g.z, round(coalesce(value, 0), 6) as value from g left join vox v on v.volume_id = g.volume_id
    and v.x + 1 = g.x and v.y - 1 = g.y and v.z = g.z""")
def pad_crop(spark, d):
    out, _ = grid.pad_or_crop(fx.packed(spark, d), fx.headers(spark, d), (6, 3, 5), groups=fx.volume_count(spark, d))
    return out.withColumn("value", F.round("value", 6))


GOAL = (18, 12, 20)


def _axis_sql(i: int) -> str:
    """Places of one axis of the new grid for both sides of the cubes: source samples and weights."""
    new = f"cast(round((n-1)/{SPACE[i]}::double) as int) + 1"
    shift = f"case when {new} <= {GOAL[i]} then cast(floor(({GOAL[i]} - ({new}))/2.0) as int) else {GOAL[i] // 2} - cast(floor(({new})/2.0) as int) end"
    return f"""(select n, t, cast(least(floor(p) + e, n-1) as int) as k, case when e = 1 then p - floor(p) else 1 - (p - floor(p)) end as w from
      (select n, t, least((t - sh) / (1.0::double / {SPACE[i]}::double), n-1) as p from (select n, t, {shift} as sh, {new} as m from
        (select unnest([16, 4]) as n) q, (select cast(unnest(range({GOAL[i]})) as int) as t) r) s where t >= sh and t < sh + m) u,
      (select cast(unnest([0, 1]) as int) as e) v)"""


@query("grid_chain_wide", f"""with {fx.VOXW}, re as (select volume_id, n, value, case when volume_id % 2 = 1 then n-1-x else z end as x,
    case when volume_id % 2 = 1 then y else n-1-x end as y, case when volume_id % 2 = 1 then z else y end as z from vox),
  made as (select volume_id, a.t as x, b.t as y, c.t as z, sum(a.w * b.w * c.w * value) as value from re
    join {_axis_sql(0)} a on a.n = re.n and a.k = re.x join {_axis_sql(1)} b on b.n = re.n and b.k = re.y
    join {_axis_sql(2)} c on c.n = re.n and c.k = re.z where a.w * b.w * c.w > 0 group by 1, 2, 3, 4),
  g as (select volume_id, a.i::int as x, b.i::int as y, c.i::int as z from (select distinct volume_id from vox) q,
    (select unnest(range({GOAL[0]})) as i) a, (select unnest(range({GOAL[1]})) as i) b, (select unnest(range({GOAL[2]})) as i) c)
  select g.volume_id, g.x, g.y, g.z, round(coalesce(value, 0), 6) as value from g
    left join made m on m.volume_id = g.volume_id and m.x = g.x and m.y = g.y and m.z = g.z""")
def grid_chain_wide(spark, d):
    """Turned, resampled, cropped and padded in one exchange of boxes, on volumes of many bricks."""
    heads = fx.wide_headers(spark, d).withColumn("orientation", F.when(F.col("volume_id") % 2 == 1, "LAS").otherwise("PSR"))
    out, _ = grid.fitted(fx.wide(spark, d), heads, "RAS", SPACE, "trilinear", GOAL, groups=fx.volume_count(spark, d), side=fx.SIDE)
    return voxels(out).withColumn("value", F.round("value", 6))


@query("patch_arrays_wide", f"""with {fx.VOXW}, pv as (select a.volume_id as pair_id, a.x, a.y, a.z, a.n, a.value as a, b.value as b
    from vox a join vox b on b.volume_id = a.volume_id + 1 and a.volume_id % 2 = 0 and a.x = b.x and a.y = b.y and a.z = b.z),
  og as (select pair_id, k as patch, """ + ", ".join(f"cast(floor({u('42', 'pair_id', 'k', repr(c))} * (n - 2)) as int) as {c}0" for c in "xyz") + """
    from (select distinct pair_id, n from pv) q, (select cast(unnest(range(4)) as int) as k) r)
  select o.pair_id, patch, cast(x - x0 as int) as dx, cast(y - y0 as int) as dy, cast(z - z0 as int) as dz, round(a, 6) as a, round(b, 6) as b
  from og o join pv on pv.pair_id = o.pair_id and x >= x0 and x < x0+3 and y >= y0 and y < y0+3 and z >= z0 and z < z0+3""")
def patch_arrays_wide(spark, d):
    """Patches of pairs of many bricks, sample by sample."""
    heads = fx.wide_headers(spark, d).where("volume_id % 2 = 0").select(F.col("volume_id").alias("pair_id"), "shape")
    rows = fx.wide_pairs(spark, d)
    heads = heads.join(rows.select("pair_id").distinct(), "pair_id", "left_semi")
    cut = tiles.routed_patches(tiles.patch_origins(heads, (3, 3, 3), 4), rows, (3, 3, 3), side=fx.SIDE)
    flat = cut.select("pair_id", "patch", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "v"))
    at = lambda by: (F.floor(F.col("pos") / by) % 3).cast("int")
    return flat.select("pair_id", "patch", at(9).alias("dx"), at(3).alias("dy"), at(1).alias("dz"), F.round("v.a", 6).alias("a"), F.round("v.b", 6).alias("b"))
