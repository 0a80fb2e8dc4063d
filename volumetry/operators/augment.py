"""Seeded augmentation. A draw depends on the seed, the volume and the operator, so results are the
same for any partitioning; draws are made on packed rows, before samples are unpacked."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetry.config import AugmentConfig
from volumetry.functions.hashing import between, normal, uniform, whole_between
from volumetry.operators.pull import pull, vector, with_map
from volumetry.operators.stencil import line_sums, stencil
from volumetry.schema import BRICK_SIDE, attach, bricks, is_packed, samples, voxels

AXES = ("x", "y", "z")
Step = Callable[[DataFrame], DataFrame]


def _gate(p: float, *parts) -> Column:
    return uniform(*parts, "gate") < F.lit(float(p))


def _with_shape(df: DataFrame, volumes: DataFrame, key: str, groups: int | None) -> DataFrame:
    return attach(df, volumes.select(key, "shape"), [key], groups, "inner")



def rand_flip(df: DataFrame, volumes: DataFrame, p: float = 0.5, axis: int = 0, seed: int = 42, key: str = "volume_id",
              value: str = "value", groups: int | None = None) -> DataFrame:
    c, tag = AXES[axis], f"flip{axis}"
    rows = voxels(_with_shape(df, volumes, key, groups).withColumn("_hit", _gate(p, seed, F.col(key), tag)), value)
    turned = F.when(F.col("_hit"), F.col("shape")[axis] - 1 - F.col(c)).otherwise(F.col(c))
    return rows.withColumn(c, turned).drop("shape", "_hit")


def _turns(p: float, seed: int, key: str) -> Column:
    parts = (seed, F.col(key), "rot90")
    return F.when(_gate(p, *parts), whole_between(1, 3, *parts, "turns")).otherwise(F.lit(0))


def rot90_headers(volumes: DataFrame, p: float = 0.5, seed: int = 42, key: str = "volume_id") -> DataFrame:
    """Headers after ``rand_rot90``: odd turns swap the first two extents."""
    s = F.col("shape")
    return volumes.withColumn("shape", F.when(_turns(p, seed, key) % 2 == 1, F.array(s[1], s[0], s[2])).otherwise(s))


def rand_rot90(df: DataFrame, volumes: DataFrame, p: float = 0.5, seed: int = 42, key: str = "volume_id",
               value: str = "value", groups: int | None = None) -> DataFrame:
    """One to three quarter turns in the plane of the first two axes."""
    rows = voxels(_with_shape(df, volumes, key, groups).withColumn("_k", _turns(p, seed, key)), value)
    x, y, k = F.col("x"), F.col("y"), F.col("_k")
    fx, fy = F.col("shape")[0] - 1 - x, F.col("shape")[1] - 1 - y
    new_x = F.when(k == 1, fy).when(k == 2, fx).when(k == 3, y).otherwise(x)
    new_y = F.when(k == 1, x).when(k == 2, fy).when(k == 3, fx).otherwise(y)
    return rows.withColumns({"x": new_x, "y": new_y}).drop("shape", "_k")


def _changed(df: DataFrame, value: str, columns: dict[str, Column], new: Column) -> DataFrame:
    rows = voxels(df.withColumns(columns), value)
    return rows.withColumn(value, new).drop(*columns)


def rand_shift(df: DataFrame, p: float = 0.3, offset: float = 0.1, seed: int = 42, key: str = "volume_id",
               value: str = "value") -> DataFrame:
    parts = (seed, F.col(key), "shift")
    by = F.when(_gate(p, *parts), between(-offset, offset, *parts, "by")).otherwise(F.lit(0.0))
    return _changed(df, value, {"_by": by}, F.col(value).cast("double") + F.col("_by"))


def rand_scale(df: DataFrame, p: float = 0.3, factor: float = 0.1, seed: int = 42, key: str = "volume_id",
               value: str = "value") -> DataFrame:
    parts = (seed, F.col(key), "scale")
    by = F.when(_gate(p, *parts), between(-factor, factor, *parts, "by")).otherwise(F.lit(0.0))
    return _changed(df, value, {"_by": by}, F.col(value).cast("double") * (1 + F.col("_by")))


def rand_noise(df: DataFrame, p: float = 0.2, std: float = 0.01, seed: int = 42, key: str = "volume_id",
               value: str = "value") -> DataFrame:
    """Gaussian noise; its std is drawn from [0, std) for each volume."""
    parts = (seed, F.col(key), "noise")
    width = F.when(_gate(p, *parts), between(0.0, std, *parts, "std")).otherwise(F.lit(0.0))
    noise = F.when(F.col("_std") > 0, normal(*parts, F.col("x"), F.col("y"), F.col("z")) * F.col("_std"))
    return _changed(df, value, {"_std": width}, F.col(value).cast("double") + F.coalesce(noise, F.lit(0.0)))


def rand_dropout(df: DataFrame, volumes: DataFrame, p: float = 0.2, holes: tuple[int, int] = (6, 10),
                 side: tuple[int, int] = (8, 32), seed: int = 42, fill: float | None = None, key: str = "volume_id",
                 value: str = "value", groups: int | None = None) -> DataFrame:
    """Boxes are filled with draws from the range of the volume, or with ``fill``. The few boxes of
    a volume travel with its rows as one array, so no join of boxes and samples is needed."""
    parts = (seed, F.col(key), "dropout")
    count = F.when(_gate(p, *parts), whole_between(*holes, *parts, "holes")).otherwise(F.lit(0))

    def box(h: Column) -> Column:
        fields = []
        for i, c in enumerate(AXES):
            n = F.col("shape")[i]
            size = F.least(whole_between(*side, *parts, h, f"{c}side"), n)
            start = whole_between(0, n - size, *parts, h, f"{c}start")
            fields += [start.alias(f"{c}0"), (start + size - 1).alias(f"{c}1")]
        return F.struct(*fields)

    based = _with_shape(df, volumes, key, groups)
    if fill is None:
        v = F.col(value).cast("double")
        ends = samples(df.select(key, value), value).groupBy(key).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        based = attach(based, ends, [key], groups)
    boxes = F.transform(F.sequence(F.lit(1), F.lit(holes[1])), box)
    boxed = based.withColumn("_n", count).withColumn("_boxes", F.slice(boxes, 1, F.col("_n")))
    rows = voxels(boxed, value)
    inside = F.exists("_boxes", lambda b: F.col("x").between(b["x0"], b["x1"]) & F.col("y").between(b["y0"], b["y1"])
                      & F.col("z").between(b["z0"], b["z1"]))
    if fill is None:
        new = F.col("_lo") + uniform(*parts, F.col("x"), F.col("y"), F.col("z")) * (F.col("_hi") - F.col("_lo"))
    else:
        new = F.lit(float(fill))
    out = rows.withColumn(value, F.when(inside, new).otherwise(F.col(value).cast("double")))
    return out.drop("shape", "_lo", "_hi", "_n", "_boxes")


def _erf(z: Column) -> Column:
    """Rational approximation of the error function (absolute error below 1.5e-7)."""
    # Fixed values of the published approximation.
    a1, a2, a3, a4, a5, q = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911
    t = F.lit(1.0) / (F.lit(1.0) + q * F.abs(z))
    poly = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t
    return F.signum(z) * (F.lit(1.0) - poly * F.exp(-z * z))


def kernel(sigma: Column, reach: int) -> Column:
    """Weights of the taps ``-reach..reach``: Gaussian mass of unit cells, cut at four sigma."""
    scale = F.lit(math.sqrt(0.5)) / sigma
    tail = F.floor(F.greatest(sigma * 4.0, F.lit(0.5)) + 0.5)

    def weight(k: Column) -> Column:
        mass = (_erf(scale * (k + 0.5)) - _erf(scale * (k - 0.5))) * 0.5
        return F.when(F.abs(k) <= tail, F.greatest(mass, F.lit(0.0))).otherwise(F.lit(0.0))

    return F.transform(F.sequence(F.lit(-reach), F.lit(reach)), weight)


def _smooth_block(axes: Sequence[str], reach: int):
    still = np.zeros(2 * reach + 1)
    still[reach] = 1.0

    def run(blocks: dict[str, np.ndarray], params: dict[str, object]) -> dict[str, np.ndarray]:
        taps = [np.array(params[f"_k{c}"]) if c in axes else still for c in AXES]
        padded, inside = np.zeros(blocks["value"].shape), params["_inside"]
        padded[inside] = blocks["value"][inside]  # only the padding is zero; a NaN sample stays one
        return {"value": line_sums(padded, taps)}

    return run


def rand_smooth(df: DataFrame, p: float = 0.2, sigma: tuple[float, float] = (0.5, 1.5), seed: int = 42,
                key: str = "volume_id", value: str = "value", axes: Sequence[str] = AXES,
                side: int = BRICK_SIDE) -> DataFrame:
    """Gaussian smoothing with a sigma of its own per volume and axis, zero outside the grid. Bricks
    exchange halos; volumes that are not drawn skip it."""
    parts = (seed, F.col(key), "smooth")
    reach = int(max(sigma[1] * 4.0, 0.5) + 0.5)
    marked = df.withColumn("_hit", _gate(p, *parts))
    calm = voxels(marked.where(~F.col("_hit")).drop("_hit"), value).withColumn(value, F.col(value).cast("double"))
    busy = marked.where("_hit").drop("_hit")
    rest = [c for c in calm.columns if c not in (*AXES, value)]
    packed = busy if is_packed(df, value) else bricks(busy, rest, value, side)
    kernels = {f"_k{c}": kernel(between(*sigma, *parts, c), reach) for c in axes}
    done = stencil(packed.withColumnRenamed(value, "value").withColumns(kernels), _smooth_block(axes, reach),
                   {"value": "array<double>"}, reach, rest, ["value"], list(kernels), side)
    return voxels(done).withColumnRenamed("value", value).unionByName(calm)


def _affine_params(cfg: AugmentConfig, seed: int, key: str) -> dict[str, Column]:
    """Rows of the map from target to source coordinates, both counted from the grid centre."""
    parts = (seed, F.col(key), "affine")
    angle = [between(-r, r, *parts, f"rotate{c}") for r, c in zip(cfg.rotate, AXES)]
    move = [between(-t, t, *parts, f"move{c}") for t, c in zip(cfg.translate, AXES)]
    size = [F.lit(1.0) + between(-s, s, *parts, f"size{c}") for s, c in zip(cfg.scale, AXES)]
    (cx, sx), (cy, sy), (cz, sz) = [(F.cos(a), F.sin(a)) for a in angle]
    zero, one = F.lit(0.0), F.lit(1.0)
    turns = [
        [[one, zero, zero], [zero, cx, -sx], [zero, sx, cx]],
        [[cy, zero, sy], [zero, one, zero], [-sy, zero, cy]],
        [[cz, -sz, zero], [sz, cz, zero], [zero, zero, one]],
    ]
    def product(a, b):
        return [[sum((a[i][k] * b[k][j] for k in range(1, 3)), a[i][0] * b[0][j]) for j in range(3)] for i in range(3)]

    m = product(product(turns[0], turns[1]), turns[2])
    return {f"_m{c}": F.array(*[m[i][j] * size[j] for j in range(3)], move[i]) for i, c in enumerate(AXES)}


def _centre(shape: Column) -> list[Column]:
    return [(shape[i] - 1) / 2.0 for i in range(3)]


def rand_affine(df: DataFrame, volumes: DataFrame, cfg: AugmentConfig | None = None, seed: int = 42,
                key: str = "volume_id", value: str = "value", groups: int | None = None,
                also: Sequence[str] = (), side: int = BRICK_SIDE) -> DataFrame:
    """Small rotation, shift and scaling about the centre, trilinear, border samples repeated. Bricks send
    each new brick the box that it can ask for. ``also`` names further values that move together with
    ``value``; long rows are packed first."""
    cfg = cfg or AugmentConfig()
    values = [value, *also]
    rest = [c for c in df.columns if c not in ("origin", "dims", *AXES, *values)]
    hit = _gate(cfg.affine_prob, seed, F.col(key), "affine")
    calm = voxels_of(df.where(~hit), values).withColumns({v: F.col(v).cast("double") for v in values})
    moving = df.where(hit)
    packed = moving if is_packed(df, value) else bricks(moving, rest, values, side)
    heads = volumes.select(key, "shape").withColumns(_affine_params(cfg, seed, key))
    rows = [F.col(f"_m{c}") for c in AXES]
    centre = _centre(F.col("shape"))
    maps = with_map(heads, vector(*[m[i] for m in rows for i in range(3)]), vector(*centre), vector(1, 1, 1),
                    vector(*[m[3] + c for m, c in zip(rows, centre)]))
    made = pull(packed, maps, "trilinear", rest, values, key, groups, side)
    return voxels_of(made, values).unionByName(calm)


def voxels_of(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Long rows of bricks with several values; long rows as they are."""
    if not is_packed(df, values[0]):
        return df
    if len(values) == 1:
        return voxels(df, values[0])
    rest = [c for c in df.columns if c not in ("origin", "dims", *values)]
    zipped = df.select(*rest, "origin", "dims", F.arrays_zip(*values).alias("_v"))
    return voxels(zipped, "_v").select(*rest, *AXES, *[F.col(f"_v.{v}").alias(v) for v in values])


def augment(df: DataFrame, volumes: DataFrame, cfg: AugmentConfig | None = None, seed: int = 42, split: str | None = None,
            only_split: str = "train", key: str = "volume_id", value: str = "value", groups: int | None = None) -> DataFrame:
    """The whole chain on the training rows; other splits, or a disabled config, pass unchanged."""
    cfg = cfg or AugmentConfig()
    plain = lambda part: voxels(part, value).withColumn(value, F.col(value).cast("double"))
    if not cfg.enabled:
        return plain(df)
    kw = {"seed": seed, "key": key, "value": value}
    steps: list[Step] = []
    if cfg.affine_prob > 0:
        steps.append(lambda x: rand_affine(x, volumes, cfg, groups=groups, **kw))
    for axis in cfg.flip_axes if cfg.flip_prob > 0 else ():
        steps.append(lambda x, a=axis: rand_flip(x, volumes, cfg.flip_prob, a, groups=groups, **kw))
    steps += [lambda x: rand_shift(x, cfg.shift_prob, cfg.shift_offset, **kw),
              lambda x: rand_scale(x, cfg.scale_prob, cfg.scale_factor, **kw),
              lambda x: rand_noise(x, cfg.noise_prob, cfg.noise_std, **kw)]
    if cfg.smooth_prob > 0:
        steps.append(lambda x: rand_smooth(x, cfg.smooth_prob, cfg.smooth_sigma, **kw))
    if cfg.dropout_prob > 0:
        steps.append(lambda x: rand_dropout(x, volumes, cfg.dropout_prob, cfg.dropout_holes, cfg.dropout_side,
                                            groups=groups, **kw))
    train = df.where(F.col(split) == only_split) if split else df
    out = compose(steps)(train)
    if split:
        out = out.unionByName(plain(df.where(F.col(split).isNull() | (F.col(split) != only_split))))
    return out


def compose(steps: Sequence[Step]) -> Step:
    """Folds a list of DataFrame functions into one."""
    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


PAIRED_AFFINE = AugmentConfig(translate=(5.0, 5.0, 5.0), scale=(0.0, 0.0, 0.0))


def _paired_map(volumes: DataFrame, p: float, seed: int, key: str, affine: AugmentConfig | None) -> DataFrame:
    """Headers with one map for flip, quarter turns and affine step, in that order, and the new shape."""
    s, k = F.col("shape"), _turns(p, seed, key)
    flipped = _gate(p, seed, F.col(key), "flip0")
    heads = volumes.select(key, "shape").withColumns({"_k": k, "_f": flipped})
    k, one, zero = F.col("_k"), F.lit(1.0), F.lit(0.0)
    pick = lambda *four: F.when(k == 1, four[1]).when(k == 2, four[2]).when(k == 3, four[3]).otherwise(four[0])
    nx, ny = (s[0] - 1).cast("double"), (s[1] - 1).cast("double")
    # from the turned grid back to the given one: a row of signs for each old axis, and what is added
    old_x, add_x = [pick(one, zero, -one, zero), pick(zero, one, zero, -one)], pick(zero, zero, nx, nx)
    old_y, add_y = [pick(zero, -one, zero, one), pick(one, zero, -one, zero)], pick(zero, ny, ny, zero)
    sign = F.when(F.col("_f"), -one).otherwise(one)
    old_x, add_x = [sign * x for x in old_x], F.when(F.col("_f"), nx - add_x).otherwise(add_x)
    back = [[*old_x, zero], [*old_y, zero], [zero, zero, one]]
    add = [add_x, add_y, zero]
    target = F.when(k % 2 == 1, F.array(s[1], s[0], s[2])).otherwise(s)
    if not affine:
        return with_map(heads, vector(*[x for row in back for x in row]), vector(0, 0, 0), vector(1, 1, 1), vector(*add), target)
    cfg = replace(affine, affine_prob=p)
    hit = _gate(p, seed, F.col(key), "affine")
    made = _affine_params(cfg, seed, key)
    unit = {c: F.array(*[F.lit(float(i == j)) for j in range(3)], zero) for i, c in enumerate(AXES)}
    heads = heads.withColumns({f"_m{c}": F.when(hit, made[f"_m{c}"]).otherwise(unit[c]) for c in AXES})
    step = [F.col(f"_m{c}") for c in AXES]
    centre = _centre(target)
    move = [m[3] + c for m, c in zip(step, centre)]
    m = [sum((row[j] * step[j][i] for j in range(1, 3)), row[0] * step[0][i]) for row in back for i in range(3)]
    d = [sum((row[j] * move[j] for j in range(1, 3)), row[0] * move[0]) + a for row, a in zip(back, add)]
    return with_map(heads, vector(*m), vector(*centre), vector(1, 1, 1), vector(*d), target)


def augment_pairs(rows: DataFrame, volumes: DataFrame, p: float = 0.5, seed: int = 42, key: str = "pair_id",
                  groups: int | None = None, affine: AugmentConfig | None = PAIRED_AFFINE, side: int = BRICK_SIDE) -> DataFrame:
    """Spatial steps move both sides together (one coordinate for ``a`` and ``b``); intensity steps
    change the input ``a`` only. ``rows`` are packed pairs, whose spatial steps are one map and one exchange of
    boxes, or long pairs."""
    tone = {"seed": seed, "key": key, "value": "a"}
    if "ab" in rows.columns:
        rows = rows.select(key, "origin", "dims", F.col("ab.a").alias("a"), F.col("ab.b").alias("b"))
    if is_packed(rows, "a"):
        maps = _paired_map(volumes, p, seed, key, affine)
        out = voxels_of(pull(rows, maps, "trilinear", [key], ["a", "b"], key, groups, side), ["a", "b"])
    else:
        spatial = {"seed": seed, "key": key, "value": "a", "groups": groups}
        out = rand_flip(rows, volumes, p, 0, **spatial)
        out = rand_rot90(out, volumes, p, **spatial)
        if affine:
            turned = rot90_headers(volumes, p, seed, key)
            out = rand_affine(out, turned, replace(affine, affine_prob=p), also=("b",), side=side, **spatial)
    out = rand_scale(out, p, 0.1, **tone)
    out = rand_shift(out, p, 0.1, **tone)
    return rand_noise(out, p * 0.5, 0.01, **tone)
