"""Spatial operators: orientation, reorientation, resampling, padding, slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetry.config import INTERPOLATIONS, check_choice
from volumetry.operators.pull import pull, vector, with_map
from volumetry.schema import BRICK_SIDE, attach, is_packed, voxels

AXES = ("x", "y", "z")
# Axis letters by world direction, negative first.
LETTERS = (("L", "R"), ("P", "A"), ("I", "S"))
PLANES = ("sagittal", "coronal", "axial")


def orientation(volumes: DataFrame, affine: str = "affine") -> DataFrame:
    """Axis codes from the affine: each column is named after its largest world component."""
    def letter(j: int) -> Column:
        parts = [F.col(affine)[r][j] for r in range(3)]
        top = F.greatest(*[F.abs(p) for p in parts])
        code = F.lit("?")
        for r in (2, 1, 0):
            code = F.when(F.abs(parts[r]) == top, F.when(parts[r] < 0, LETTERS[r][0]).otherwise(LETTERS[r][1])).otherwise(code)
        return code

    return volumes.withColumn("orientation", F.concat(*[letter(j) for j in range(3)]))


def _opposite(letter: str) -> str:
    return next(b if letter == a else a for a, b in LETTERS if letter in (a, b))


def _picker(target: str):
    """``pick(i, same, flipped)``: for axis i of ``target``, the value that a function gives for the old axis
    it comes from, by whether that keeps its direction."""
    def pick(i: int, same, flipped) -> Column:
        letter, out = target[i], None
        for j in range(3):
            code = F.substring("orientation", j + 1, 1)
            out = (F if out is None else out).when(code == letter, same(j)).when(code == _opposite(letter), flipped(j))
        return out

    return pick


def reorient(df: DataFrame, volumes: DataFrame, target: str = "RAS", value: str = "value",
             groups: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Permutes and flips axes to ``target``: a projection of coordinates by the header row."""
    pick, shape = _picker(target), lambda j: F.col("shape")[j]
    rows = voxels(attach(df, volumes.select("volume_id", "shape", "orientation"), ["volume_id"], groups, "inner"), value)
    moved = {c: pick(i, lambda j: F.col(AXES[j]), lambda j: shape(j) - 1 - F.col(AXES[j])) for i, c in enumerate(AXES)}
    return rows.withColumns(moved).drop("shape", "orientation"), turned_headers(volumes, target)


def turned_headers(volumes: DataFrame, target: str = "RAS") -> DataFrame:
    """Headers after ``reorient``."""
    pick, shape = _picker(target), lambda j: F.col("shape")[j]
    new_shape = F.array(*[pick(i, shape, shape) for i in range(3)])
    head = {"shape": new_shape, "orientation": F.lit(target)}
    if "spacing" in volumes.columns:
        space = lambda j: F.col("spacing")[j]
        head["spacing"] = F.array(*[pick(i, space, space) for i in range(3)])
    if "affine" in volumes.columns:
        head["affine"] = _turned_affine(pick)
    return volumes.withColumns(head)


def _turned_affine(pick) -> Column:
    at = lambda r, j: F.col("affine")[r][j]
    rows = []
    for r in range(3):
        axes = [pick(i, lambda j: at(r, j), lambda j: -at(r, j)) for i in range(3)]
        shift = at(r, 3)
        for i in range(3):
            shift = shift + pick(i, lambda j: F.lit(0.0), lambda j: at(r, j) * (F.col("shape")[j] - 1))
        rows.append(F.array(*axes, shift))
    return F.array(*rows, F.col("affine")[3])


def resampled_shape(old_spacing: Column, shape: Column, new: Sequence[float]) -> Column:
    """``round((n - 1) * old / new) + 1`` on each axis."""
    return F.array(*[(F.round((shape[i] - 1) * old_spacing[i] / F.lit(float(new[i]))) + 1).cast("int") for i in range(3)])


def resample(df: DataFrame, volumes: DataFrame, spacing: Sequence[float], mode: str = "trilinear", value: str = "value",
             groups: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Resamples to ``spacing`` by scattering: every source sample adds its weighted value to the
    few target samples near it. Contributions of a brick merge before the only shuffle; no join of
    samples, and the work does not depend on how large one volume is. Borders are clamped."""
    check_choice("interpolation", mode, INTERPOLATIONS)
    head = volumes.withColumn("_new", resampled_shape(F.col("spacing"), F.col("shape"), spacing))
    params = head.select("volume_id", "shape", "spacing", "_new")
    rows = voxels(attach(df, params, ["volume_id"], groups, "inner"), value)
    weight = F.lit(1.0)
    for i, c in enumerate(AXES):
        ratio = F.col("spacing")[i] / F.lit(float(spacing[i]))
        last, top = F.col("shape")[i] - 1, F.col("_new")[i] - 1
        low = F.greatest(F.ceil((F.col(c) - 1) * ratio).cast("int"), F.lit(0))
        high = F.when(F.col(c) >= last - 1, top).otherwise(F.least(F.floor((F.col(c) + 1) * ratio).cast("int"), top))
        pos = lambda t: F.least(t / ratio, last.cast("double"))
        if mode == "trilinear":
            near = lambda t: F.lit(1.0) - F.abs(pos(t) - F.col(c))
        else:
            near = lambda t: (F.floor(pos(t) + 0.5) == F.col(c)).cast("double")
        targets = F.filter(F.transform(F.sequence(low, F.greatest(low, high)), lambda t: F.struct(
            t.alias("t"), near(t).alias("w"))), lambda s: (s.w > 0) & (s.t <= top))
        rows = rows.withColumn("_t", F.explode(targets)).withColumns({f"_{c}": F.col("_t.t"), f"_w{c}": F.col("_t.w")})
        weight = weight * F.col(f"_w{c}")
    coords = [F.col(f"_{c}").alias(c) for c in AXES]
    if mode == "nearest":  # exactly one source per target: nothing to add up
        out = rows.select("volume_id", *coords, F.col(value).cast("double").alias(value))
    else:
        out = rows.groupBy("volume_id", *coords).agg(F.sum(weight * F.col(value).cast("double")).alias(value))
    space = F.array(*[F.lit(float(s)) for s in spacing])
    return out, head.withColumns({"shape": F.col("_new"), "spacing": space}).drop("_new")


def _shift(n: Column, size: int) -> Column:
    """Steps that an axis of ``n`` samples moves when it is centred in ``size``."""
    pad = F.floor((F.lit(size) - n) / 2).cast("int")
    return F.when(n <= size, pad).otherwise(F.lit(size // 2) - F.floor(n / 2).cast("int"))


def pad_or_crop(df: DataFrame, volumes: DataFrame, size: Sequence[int], value: str = "value",
                groups: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Centres a dense volume in ``size``: shifts and filters its samples and adds the zeros around
    them from the header alone, so nothing is joined to the full grid."""
    head = volumes.select("volume_id", "shape")
    shift = [_shift(F.col("shape")[i], size[i]) for i in range(3)]
    rows = voxels(attach(df, head, ["volume_id"], groups, "inner"), value)
    moved = rows.withColumns({c: F.col(c) + shift[i] for i, c in enumerate(AXES)})
    inside = F.lit(True)
    for i, c in enumerate(AXES):
        inside = inside & F.col(c).between(0, size[i] - 1)
    kept = moved.where(inside).select("volume_id", *AXES, F.col(value).cast("double").alias(value))
    grid = head
    for i, c in enumerate(AXES):
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(size[i] - 1))))
    covered = F.lit(True)
    for i, c in enumerate(AXES):
        start = F.greatest(shift[i], F.lit(0))
        covered = covered & F.col(c).between(start, start + F.least(F.col("shape")[i], F.lit(size[i])) - 1)
    around = grid.where(~covered).select("volume_id", *AXES, F.lit(0.0).alias(value))
    return kept.unionByName(around), volumes.withColumn("shape", F.array(*[F.lit(s) for s in size]))


def fitted(packed: DataFrame, volumes: DataFrame, target: str | None = "RAS", spacing: Sequence[float] | None = None, mode: str = "trilinear",
           size: Sequence[int] | None = None, value: str = "value", groups: int | None = None, side: int = BRICK_SIDE) -> tuple[DataFrame, DataFrame]:
    """``reorient``, ``resample`` and ``pad_or_crop`` of bricks as one map a volume: samples are read once,
    boxes are exchanged once, and new bricks come out. A step without its argument is left out."""
    pick = _picker(target) if target else lambda i, same, flipped: same(i)
    shape, heads = lambda j: F.col("shape")[j], volumes
    number = lambda x: F.lit(float(x))
    turned = [pick(i, shape, shape) for i in range(3)]
    ratio, new = [number(1)] * 3, turned
    if spacing:
        space = lambda j: F.col("spacing")[j]
        old = F.array(*[pick(i, space, space) for i in range(3)])
        new = [resampled_shape(old, F.array(*turned), spacing)[i] for i in range(3)]
        ratio = [old[i] / number(spacing[i]) for i in range(3)]
    goal = [F.lit(n) for n in size] if size else new
    shift = [_shift(n, s) for n, s in zip(new, size)] if size else [F.lit(0)] * 3
    turn = [pick(i, lambda k: number(k == j), lambda k: number(-(k == j))) for j in range(3) for i in range(3)]
    back = [sum((pick(i, lambda k: number(0), lambda k: F.when(F.lit(k == j), shape(k) - 1).otherwise(0).cast("double")) for i in range(3)), number(0))
            for j in range(3)]
    low = [F.greatest(s, F.lit(0)) for s in shift]
    high = [F.least(s + n, g) - 1 for s, n, g in zip(shift, new, goal)]
    maps = with_map(volumes.select("volume_id", *[c for c in ("shape", "spacing", "orientation") if c in volumes.columns]), vector(*turn), vector(*shift),
                    vector(*ratio), vector(*back), F.array(*goal), F.array(*low), F.array(*high))
    out = pull(packed, maps, mode, ["volume_id"], [value], groups=groups, side=side)
    if target:
        heads = turned_headers(heads, target)
    if spacing:
        new_shape = resampled_shape(F.col("spacing"), F.col("shape"), spacing)
        heads = heads.withColumns({"shape": new_shape, "spacing": F.array(*[number(s) for s in spacing])})
    if size:
        heads = heads.withColumn("shape", F.array(*[F.lit(n) for n in size]))
    return out, heads


def mid_slices(df: DataFrame, volumes: DataFrame, value: str = "value", at: Sequence[int] | None = None,
               groups: int | None = None) -> DataFrame:
    """The middle (or given) slice on each axis, labelled by plane, in one pass. Bricks that no asked
    plane crosses are left packed and dropped."""
    def index(i: int) -> Column:
        return F.lit(at[i]) if at else F.floor(F.col("shape")[i] / 2).cast("int")

    based = attach(df, volumes.select("volume_id", "shape"), ["volume_id"], groups, "inner")
    if is_packed(df, value):
        crossed = F.lit(False)
        for i in range(3):
            start = F.col("origin")[i]
            crossed = crossed | ((index(i) >= start) & (index(i) < start + F.col("dims")[i]))
        based = based.where(crossed)
    rows = voxels(based, value)
    hits = F.array_compact(F.array(*[F.when(F.col(c) == index(i), F.lit(PLANES[i])) for i, c in enumerate(AXES)]))
    return rows.withColumn("plane", F.explode(hits)).drop("shape")
