"""Seeded augmentation; the SQL draws the same numbers from md5."""

from __future__ import annotations

from pyspark.sql import functions as F

from volumetry.config import AugmentConfig
from volumetry.operators import augment, evaluate
from volumetry.plans import fixtures as fx
from volumetry.plans.queries.pairs import packed_pairs
from volumetry.plans.queries.space import u
from volumetry.plans.registry import query


def dr(tag: str, *more: str, key: str = "volume_id") -> str:
    return u("42", key, repr(tag), *more)


def rounded(df, *columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns or ("value",)})


@query("aug_flip", f"""with {fx.VOX} select volume_id, case when {dr('flip0', repr('gate'))} < 0.5 then 3 - x else x end as x,
  y, z, round(value, 6) as value from vox""")
def aug_flip(spark, d):
    return rounded(augment.rand_flip(fx.packed(spark, d), fx.headers(spark, d), groups=fx.volume_count(spark, d)))


TURN = f"""case when {dr('rot90', repr('gate'))} < 0.5 then cast(1 + floor({dr('rot90', repr('turns'))} * 3.0) as int) else 0 end"""


@query("aug_rot90", f"""with {fx.VOX}, t as (select *, {TURN} as k from vox)
  select volume_id, case k when 1 then 3-y when 2 then 3-x when 3 then y else x end as x,
    case k when 1 then x when 2 then 3-y when 3 then 3-x else y end as y, z, round(value, 6) as value from t""")
def aug_rot90(spark, d):
    return rounded(augment.rand_rot90(fx.packed(spark, d), fx.headers(spark, d), groups=fx.volume_count(spark, d)))


def amount(tag: str, p: float, size: float, key: str = "volume_id") -> str:
    return (f"(case when {dr(tag, repr('gate'), key=key)} < {p}::double then -{size}::double + "
            f"{dr(tag, repr('by'), key=key)} * {2 * size}::double else 0 end)")


@query("aug_intensity", f"""with {fx.VOX} select volume_id, x, y, z,
  round((value + {amount('shift', 0.3, 0.1)}) * (1 + {amount('scale', 0.3, 0.1)}), 6) as value from vox""")
def aug_intensity(spark, d):
    return rounded(augment.rand_scale(augment.rand_shift(fx.packed(spark, d))))


NOISE = f"""(case when {dr('noise', repr('gate'))} < 0.2 then {dr('noise', repr('std'))} * 0.01 else 0 end)"""


@query("aug_noise", f"""with {fx.VOX} select volume_id, x, y, z, round(value + {NOISE} *
  sqrt(-2.0 * ln(1.0 - {dr('noise', 'x', 'y', 'z', repr('radius'))})) *
  cos(2 * pi() * {dr('noise', 'x', 'y', 'z', repr('angle'))}), 6) as value from vox""")
def aug_noise(spark, d):
    return rounded(augment.rand_noise(fx.packed(spark, d)))


def _box_sql() -> str:
    size = lambda c: f"cast(1 + floor({dr('dropout', 'h', repr(c + 'side'))} * 2.0) as int)"
    start = lambda c: f"cast(floor({dr('dropout', 'h', repr(c + 'start'))} * (4 - {c}s + 1)) as int)"
    return (f"hs as (select vec_id as volume_id, h from embeddings, (select cast(unnest(range(1, 4)) as int) as h) q), "
            f"hz as (select *, {size('x')} as xs, {size('y')} as ys, {size('z')} as zs from hs "
            f"where {dr('dropout', repr('gate'))} < 0.5 and h <= 1 + floor({dr('dropout', repr('holes'))} * 3.0)), "
            f"hb as (select *, {start('x')} as x0, {start('y')} as y0, {start('z')} as z0 from hz)")


@query("aug_dropout", f"""with {fx.VOX}, {_box_sql()}, e as (select volume_id, min(value) as lo, max(value) as hi from vox group by 1),
  hit as (select distinct v.volume_id, x, y, z from vox v join hb on hb.volume_id = v.volume_id and x between x0 and x0+xs-1
    and y between y0 and y0+ys-1 and z between z0 and z0+zs-1)
  select v.volume_id, v.x, v.y, v.z, round(case when hit.x is null then value
    else lo + {dr('dropout', 'v.x', 'v.y', 'v.z', key='v.volume_id')} * (hi - lo) end, 6) as value
  from vox v join e using (volume_id) left join hit on hit.volume_id = v.volume_id and hit.x = v.x and hit.y = v.y and hit.z = v.z""")
def aug_dropout(spark, d):
    out = augment.rand_dropout(fx.packed(spark, d), fx.headers(spark, d), 0.5, (1, 3), (1, 2), groups=fx.volume_count(spark, d))
    return rounded(out)


def erf_sql(z: str) -> str:
    t = f"(1.0/(1.0+0.3275911*abs({z})))"
    poly = f"((((1.061405429*{t}-1.453152027)*{t}+1.421413741)*{t}-0.284496736)*{t}+0.254829592)*{t}"
    return f"(sign({z})*(1.0-({poly})*exp(-({z})*({z}))))"


@query("smooth_axis", f"""with {fx.VOX}, g as (select vec_id as volume_id from embeddings),
  sg as (select volume_id, 0.5 + {dr('smooth', repr('x'))} * 1.0 as s from g where {dr('smooth', repr('gate'))} < 0.5),
  tp as (select volume_id, k, case when abs(k) <= floor(greatest(s*4, 0.5) + 0.5) then greatest(0.5*({erf_sql('(sqrt(0.5::double)/s*(k+0.5))')}
    - {erf_sql('(sqrt(0.5::double)/s*(k-0.5))')}), 0) else 0 end as w from sg, (select cast(unnest(range(-6, 7)) as double) as k) q)
  select v.volume_id, v.x, v.y, v.z, round(case when max(tp.k) is null then max(v.value)
    else sum(tp.w * coalesce(n.value, 0)) end, 6) as value
  from vox v left join tp on tp.volume_id = v.volume_id
  left join vox n on n.volume_id = v.volume_id and n.y = v.y and n.z = v.z and n.x = v.x - tp.k group by 1, 2, 3, 4""")
def smooth_axis(spark, d):
    return rounded(augment.rand_smooth(fx.packed(spark, d), 0.5, axes=("x",)))


@query("aug_smooth")
def aug_smooth(spark, d):
    return rounded(augment.rand_smooth(fx.packed(spark, d), 0.5))


def affine_sql(source: str, cfg: AugmentConfig, key: str = "volume_id", values: tuple[str, ...] = ("value",), out: str = "af") -> str:
    """Rows of ``source`` (with the side ``n`` of the cube) after the affine step, as the table ``out``."""
    draw = lambda name, size: f"(-{size}::double + {dr('affine', repr(name), key=key)} * {2 * size}::double)"
    drawn = ", ".join(f"{draw(f'{what}{c}', size)} as {what}{c}" for what, sizes in (("rotate", cfg.rotate), ("move", cfg.translate), ("size", cfg.scale))
                      for c, size in zip("xyz", sizes))
    turns = ", ".join(f"{f}(rotate{c}) as {f[0]}{c}" for f in ("cos", "sin") for c in "xyz")
    m = [["cy*cz", "-cy*sz", "sy"], ["sx*sy*cz+cx*sz", "cx*cz-sx*sy*sz", "-sx*cy"], ["sx*sz-cx*sy*cz", "cx*sy*sz+sx*cz", "cx*cy"]]
    place = lambda i: " + ".join(f"({m[i][j]})*(1+size{c})*({c}-(n-1)/2.0::double)" for j, c in enumerate("xyz"))
    at = ", ".join(f"greatest(least({place(i)} + move{c} + (n-1)/2.0::double, n-1), 0) as p{c}" for i, c in enumerate("xyz"))
    corner = ", ".join(f"cast(least(floor(p{c}) + e{c}, n-1) as int) as k{c}, case when e{c} = 1 then p{c} - floor(p{c}) else 1 - (p{c} - floor(p{c})) end as w{c}" for c in "xyz")
    bit = "(select cast(unnest([0, 1]) as int) as e{0}) q{0}"
    sums = ", ".join(f"sum(wx * wy * wz * s.{v}) as {v}" for v in values)
    gate = f"{dr('affine', repr('gate'), key=key)} < {cfg.affine_prob}::double"
    return f"""{out}v as (select distinct {key} from {source}), {out}d as (select {key}, {gate} as hit, {drawn} from {out}v),
  {out}t as (select *, {turns} from {out}d), {out}p as (select s.*, {at} from {source} s join {out}t using ({key}) where hit),
  {out}c as (select {key}, x, y, z, n, {corner} from {out}p, {", ".join(bit.format(c) for c in "xyz")}),
  {out} as (select c.{key}, c.x, c.y, c.z, {sums} from {out}c c join {source} s on s.{key} = c.{key} and s.x = kx and s.y = ky and s.z = kz
    where wx * wy * wz > 0 group by 1, 2, 3, 4
    union all select {key}, x, y, z, {", ".join(values)} from {source} join {out}t using ({key}) where not hit)"""


CUBE = "cube as (select *, 4 as n from vox)"
SHIFTED = AugmentConfig(translate=(1.0, 1.0, 1.0))


@query("aug_affine", f"with {fx.VOX}, {CUBE}, {affine_sql('cube', SHIFTED)} select volume_id, x, y, z, round(value, 6) as value from af")
def aug_affine(spark, d):
    return rounded(augment.rand_affine(fx.packed(spark, d), fx.headers(spark, d), SHIFTED, groups=fx.volume_count(spark, d)))


FAR = AugmentConfig(affine_prob=0.8, rotate=(0.5, 0.9, 0.3), translate=(3.0, 2.0, 4.0), scale=(0.3, 0.2, 0.1))


@query("aug_affine_wide", f"with {fx.VOXW}, {affine_sql('vox', FAR)} select volume_id, x, y, z, round(value, 6) as value from af")
def aug_affine_wide(spark, d):
    """Volumes of many bricks, turned far enough to ask bricks beyond the next."""
    return rounded(augment.rand_affine(fx.wide(spark, d), fx.wide_headers(spark, d), FAR, groups=fx.volume_count(spark, d), side=fx.SIDE))


@query("aug_train_only", f"""with {fx.CAT}, {fx.VOX} select volume_id, modality as split,
  case when modality = 'T1w' and {dr('flip0', repr('gate'))} < 0.5 then 3 - x else x end as x, y, z,
  round(case when modality = 'T1w' then (value + {amount('shift', 0.3, 0.1)}) * (1 + {amount('scale', 0.3, 0.1)}) else value end, 6) as value
  from vox join cat using (volume_id)""")
def aug_train_only(spark, d):
    rows = fx.packed(spark, d).join(fx.catalog(spark, d).select("volume_id", F.col("modality").alias("split")), "volume_id")
    cfg = AugmentConfig(affine_prob=0.0, noise_prob=0.0, smooth_prob=0.0)
    return rounded(augment.augment(rows, fx.headers(spark, d), cfg, split="split", only_split="T1w",
                                   groups=fx.volume_count(spark, d)))


@query("aug_paired", f"""with {fx.PAIRS}, f as (select pair_id, case when {dr('flip0', repr('gate'), key='pair_id')} < 0.5 then 3-x else x end as x,
    y, z, a, b, case when {dr('rot90', repr('gate'), key='pair_id')} < 0.5 then cast(1 + floor({dr('rot90', repr('turns'), key='pair_id')} * 3.0) as int)
    else 0 end as k from pv),
  t as (select pair_id, case k when 1 then 3-y when 2 then 3-x when 3 then y else x end as x,
    case k when 1 then x when 2 then 3-y when 3 then 3-x else y end as y, z, b,
    a * (1 + {amount('scale', 0.5, 0.1, 'pair_id')}) + {amount('shift', 0.5, 0.1, 'pair_id')} as a from f)
  select pair_id, x, y, z, round(a + (case when {dr('noise', repr('gate'), key='pair_id')} < 0.25 then {dr('noise', repr('std'), key='pair_id')} * 0.01 else 0 end)
    * sqrt(-2.0 * ln(1.0 - {dr('noise', 'x', 'y', 'z', repr('radius'), key='pair_id')}))
    * cos(2 * pi() * {dr('noise', 'x', 'y', 'z', repr('angle'), key='pair_id')}), 6) as a, round(b, 6) as b from t""")
def aug_paired(spark, d):
    heads = fx.headers(spark, d).select(F.col("volume_id").alias("pair_id"), "shape")
    rows = evaluate.pair_voxels(packed_pairs(spark, d))
    return rounded(augment.augment_pairs(rows, heads, groups=fx.volume_count(spark, d), affine=None), "a", "b")


def paired_sql(source: str, p: float = 0.5) -> str:
    """The paired chain with its affine step on rows ``(pair_id, x, y, z, n, a, b)``."""
    one = lambda *parts: dr(*parts, key="pair_id")
    return f"""f as (select pair_id, case when {one('flip0', repr('gate'))} < {p} then n-1-x else x end as x, y, z, n, a, b,
    case when {one('rot90', repr('gate'))} < {p} then cast(1 + floor({one('rot90', repr('turns'))} * 3.0) as int) else 0 end as k from {source}),
  r as (select pair_id, case k when 1 then n-1-y when 2 then n-1-x when 3 then y else x end as x,
    case k when 1 then x when 2 then n-1-y when 3 then n-1-x else y end as y, z, n, a, b from f),
  {affine_sql('r', augment.PAIRED_AFFINE, 'pair_id', ('a', 'b'))}
  select pair_id, x, y, z, round(a * (1 + {amount('scale', p, 0.1, 'pair_id')}) + {amount('shift', p, 0.1, 'pair_id')}
    + (case when {one('noise', repr('gate'))} < {p / 2} then {one('noise', repr('std'))} * 0.01 else 0 end)
    * sqrt(-2.0 * ln(1.0 - {one('noise', 'x', 'y', 'z', repr('radius'))})) * cos(2 * pi() * {one('noise', 'x', 'y', 'z', repr('angle'))}), 6) as a,
    round(b, 6) as b from af"""


@query("aug_paired_affine", f"with {fx.PAIRS}, cube as (select *, 4 as n from pv), {paired_sql('cube')}")
def aug_paired_affine(spark, d):
    """The full paired chain; flip, turns and affine step are one map, and pairs stay packed until then."""
    heads = fx.headers(spark, d).select(F.col("volume_id").alias("pair_id"), "shape")
    return rounded(augment.augment_pairs(packed_pairs(spark, d), heads, groups=fx.volume_count(spark, d)), "a", "b")


@query("aug_paired_affine_wide", f"""with {fx.VOXW}, pw as (select a.volume_id as pair_id, a.x, a.y, a.z, a.n, a.value as a, b.value as b
    from vox a join vox b on b.volume_id = a.volume_id + 1 and a.volume_id % 2 = 0 and a.x = b.x and a.y = b.y and a.z = b.z), {paired_sql('pw')}""")
def aug_paired_affine_wide(spark, d):
    heads = fx.wide_headers(spark, d).select(F.col("volume_id").alias("pair_id"), "shape")
    return rounded(augment.augment_pairs(fx.wide_pairs(spark, d), heads, groups=fx.volume_count(spark, d), side=fx.SIDE), "a", "b")
