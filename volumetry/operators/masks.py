"""Masks and morphology on voxel tables. A set is a table of its voxels; neighbours are the six
across faces and everything outside the grid counts as empty."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volumetry.operators.ordering import percentiles
from volumetry.schema import BRICK_SIDE, attach, finite, is_packed, positive, voxels
from volumetry.session import cut_lineage

XYZ = ("x", "y", "z")
CROSS = ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))
ORDER_BITS = 21  # a grid axis has fewer than 2**21 samples


def threshold_mask(df: DataFrame, p: float = 10.0, keys: Sequence[str] = ("volume_id",), value: str = "value",
                   groups: int | None = None) -> DataFrame:
    """``in_mask``: above the p-th percentile of positive samples; nothing in an empty volume."""
    # one small row per volume, stored because the set and its background both read it
    cut = cut_lineage(percentiles(df, keys, value, [p], lambda v: positive(v) & finite(v), groups).select(
        *keys, F.col("pct")[0].alias("_cut")))
    v = F.col(value).cast("double")
    rows = voxels(attach(df, cut, keys, groups), value)
    return rows.withColumn("in_mask", F.coalesce((v > F.col("_cut")) & ~F.isnan(v), F.lit(False))).drop("_cut")


def apply_mask(df: DataFrame, mask: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "value") -> DataFrame:
    """Samples outside the set become 0. ``mask`` is a table of voxels, or of bricks with values > 0
    inside, cut like those of ``df``; bricks are joined as bricks."""
    if value in mask.columns and is_packed(mask, value) and is_packed(df, value):
        side = mask.select(*keys, "origin", F.col(value).alias("_m"))
        joined = df.join(side, [*keys, "origin"], "left")
        return joined.withColumn(value, F.when(F.col("_m").isNull(), F.transform(value, lambda v: v * 0)).otherwise(
            F.zip_with(value, "_m", lambda v, m: F.when(m > 0, v).otherwise(v * 0)))).drop("_m")
    on = [*keys, *XYZ]
    marked = mask.select(*on).withColumn("_in", F.lit(1.0))
    rows = voxels(df, value).join(marked, on, "left")
    return rows.withColumn(value, F.col(value).cast("double") * F.coalesce("_in", F.lit(0.0))).drop("_in")


def packed_mask(rows: DataFrame, packed: DataFrame, side: int = BRICK_SIDE, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """A set of voxels as bricks of 0 and 1, cut like ``packed`` (bricks that start at multiples of
    ``side``); bricks without a voxel of the set are missing. Only the set is moved, not the samples."""
    start = F.array(*[(F.floor(F.col(c) / side) * side).cast("int").alias(c) for c in XYZ])
    held = rows.groupBy(*keys, start.alias("origin")).agg(F.collect_list(F.struct(*XYZ)).alias("_set"))
    cut = packed.select(*keys, "origin", "dims").join(held, [*keys, "origin"])
    at = lambda v: ((v["x"] - F.col("origin")[0]) * F.col("dims")[1] + v["y"] - F.col("origin")[1]) * F.col("dims")[2] + v["z"] - F.col("origin")[2]
    found = F.array_sort(F.transform("_set", at))
    size = F.col("dims")[0] * F.col("dims")[1] * F.col("dims")[2]
    # ordered places turn into stretches of zeros, each with a one behind it
    before = lambda v, i: F.when(i == 0, v).otherwise(v - F.get("_at", i - 1) - 1)
    stretches = F.transform("_at", lambda v, i: F.concat(F.array_repeat(F.lit(0.0), before(v, i)), F.array(F.lit(1.0))))
    tail = F.array_repeat(F.lit(0.0), size - 1 - F.element_at("_at", -1))
    return cut.withColumn("_at", found).select(*keys, "origin", F.concat(F.flatten(stretches), tail).alias("value"))


def _spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    steps = F.array(*[F.struct(*[(F.col(c) + o).alias(c) for c, o in zip(XYZ, off)]) for off in CROSS])
    return rows.select(*keys, F.explode(steps).alias("_p")).select(*keys, "_p.*")


def erode(rows: DataFrame, n: int = 1, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Keeps voxels whose six neighbours are set: each voxel votes for itself and its neighbours,
    votes merge before the shuffle, and seven votes are needed."""
    for _ in range(n):
        votes = _spread(rows, keys).groupBy(*keys, *XYZ).agg(F.count(F.lit(1)).alias("_n"))
        rows = votes.where(F.col("_n") == len(CROSS)).drop("_n")
    return rows


def dilate(rows: DataFrame, volumes: DataFrame, n: int = 1, keys: Sequence[str] = ("volume_id",),
           groups: int | None = None) -> DataFrame:
    """Adds the six neighbours, inside the grid, ``n`` times."""
    cur = attach(rows, volumes.select(*keys, "shape"), keys, groups, "inner")
    for _ in range(n):
        inside = F.lit(True)
        for i, c in enumerate(XYZ):
            inside = inside & (F.col(c) >= 0) & (F.col(c) < F.col("shape")[i])
        cur = _spread(cur, [*keys, "shape"]).where(inside).groupBy(*keys, *XYZ).agg(F.first("shape").alias("shape"))
    return cur.drop("shape")


def runs(rows: DataFrame, keys: Sequence[str] = ("volume_id",), side: int = BRICK_SIDE) -> DataFrame:
    """Joins voxels that follow each other on a line of a brick into runs ``z0..z1``; a window holds
    one such line. ``node`` orders runs as their first voxels come in the grid."""
    part = F.floor(F.col("z") / side).cast("int")
    line = Window.partitionBy(*keys, "x", "y", "bz").orderBy("z")
    marked = rows.select(*keys, *XYZ).withColumn("bz", part).withColumn("_g", F.col("z") - F.row_number().over(line))
    out = marked.groupBy(*keys, "x", "y", "bz", "_g").agg(F.min("z").alias("z0"), F.max("z").alias("z1")).drop("_g")
    place = lambda c, bits: F.shiftleft(F.col(c).cast("long"), bits)
    brick = lambda c: F.floor(F.col(c) / side).cast("int")
    return out.withColumns({
        "node": place("x", 2 * ORDER_BITS) + place("y", ORDER_BITS) + F.col("z0"), "bx": brick("x"), "by": brick("y")})


def _label_brick(rows: pa.Table) -> pa.Table:
    """Smallest run number of each component inside one brick; a brick is bounded, a volume is not."""
    rows = rows.sort_by("node")
    x, y, z0, z1 = (rows.column(c).to_numpy().tolist() for c in ("x", "y", "z0", "z1"))
    parent = list(range(len(x)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    lines: dict[tuple[int, int], list[int]] = {}
    for i in range(len(x)):
        for before in ((x[i] - 1, y[i]), (x[i], y[i] - 1)):
            for j in lines.get(before, ()):
                if z0[j] <= z1[i] and z1[j] >= z0[i]:
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
        lines.setdefault((x[i], y[i]), []).append(i)
    node = rows.column("node").to_numpy()
    return rows.append_column("part", pa.array([node[root(i)] for i in range(len(x))], pa.int64()))


def _crossing(r: DataFrame, keys: Sequence[str], side: int) -> DataFrame:
    """Edges between parts of neighbouring bricks: runs on a face meet the runs of the next line that
    share a z, or the run that goes on behind the face; equality joins on the line."""
    last = lambda c: F.col(c) % side == side - 1
    step = lambda dx, dy, a, b: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), a.alias("a0"), b.alias("a1"))
    ahead = F.array_compact(F.array(
        F.when(last("x"), step(1, 0, F.col("z0"), F.col("z1"))), F.when(last("y"), step(0, 1, F.col("z0"), F.col("z1"))),
        F.when(last("z1"), step(0, 0, F.col("z1") + 1, F.col("z1") + 1))))
    left = r.select(*keys, F.col("part").alias("v"), F.explode(ahead).alias("_l")).select(*keys, "v", "_l.*")
    right = r.select(*keys, "x", "y", "z0", "z1", F.col("part").alias("u"))
    met = left.join(right, [*keys, "x", "y"]).where((F.col("z0") <= F.col("a1")) & (F.col("z1") >= F.col("a0")))
    return met.select(*keys, "u", "v")


def _stars(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Connected components by alternating large-star and small-star steps. Every step is a minimum
    per node (merged before the shuffle) joined back to the edges; no neighbour list is collected."""
    keys = list(keys)
    smaller = lambda e: e.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(
        F.col("u") != F.col("v")).distinct()
    cur = cut_lineage(smaller(edges))
    if _settled(cur, keys):
        return cur
    while True:
        both = cur.unionByName(cur.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = smaller(both.where(F.col("v") > F.col("u")).join(low, [*keys, "u"]).select(
            *keys, F.col("v").alias("u"), F.col("m").alias("v")))
        floor = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(floor, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        cur = cut_lineage(smaller(small.unionByName(floor.withColumnRenamed("m", "v"))))
        if _settled(cur, keys):
            return cur


def _settled(edges: DataFrame, keys: list[str]) -> bool:
    """True when every node has one edge and no centre has one: the edges are stars."""
    ends = edges.select(*keys, F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"))
    )).alias("_e")).select(*keys, "_e.*")
    per = ends.groupBy(*keys, "node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return per.where((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("least") == 0))).isEmpty()


def components(rows: DataFrame, keys: Sequence[str] = ("volume_id",), side: int = BRICK_SIDE) -> DataFrame:
    """Runs with the ``label`` of their component: its first run in grid order. Bricks are labelled
    by themselves; only the parts that touch across brick faces take part in the rounds."""
    keys = list(keys)
    r = runs(rows, keys, side)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in r.schema) + ", part long"
    parts = cut_lineage(r.groupBy(*keys, "bx", "by", "bz").applyInArrow(_label_brick, schema))
    star = _stars(_crossing(parts, keys, side), keys).select(*keys, F.col("u").alias("part"), F.col("v").alias("_top"))
    return parts.join(star, [*keys, "part"], "left").select(
        *keys, "x", "y", "z0", "z1", F.coalesce("_top", "part").alias("label"))


def _voxels_of(r: DataFrame, keys: Sequence[str]) -> DataFrame:
    return r.select(*keys, "x", "y", F.explode(F.sequence("z0", "z1")).alias("z"))


def largest_component(rows: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Voxels of the biggest component; a tie goes to the one that starts first in the grid."""
    keys = list(keys)
    labelled = components(rows, keys)
    sizes = labelled.groupBy(*keys, "label").agg(F.sum(F.col("z1") - F.col("z0") + 1).alias("_n"))
    best = sizes.groupBy(*keys).agg(F.max(F.struct(F.col("_n"), (-F.col("label")).alias("_l"))).alias("_b")).select(
        *keys, (-F.col("_b._l")).alias("label"))
    return _voxels_of(labelled.join(best, [*keys, "label"], "left_semi"), keys)


def fill_holes(dense: DataFrame, volumes: DataFrame, keys: Sequence[str] = ("volume_id",), mask: str = "in_mask",
               groups: int | None = None) -> DataFrame:
    """Set voxels plus every background component that does not reach the border of the grid."""
    keys = list(keys)
    labelled = attach(components(dense.where(~F.col(mask)), keys), volumes.select(*keys, "shape"), keys, groups, "inner")
    edge = lambda i: F.col("shape")[i] - 1
    border: Column = (F.col("z0") == 0) | (F.col("z1") == edge(2))
    for i, c in enumerate("xy"):
        border = border | (F.col(c) == 0) | (F.col(c) == edge(i))
    open_ones = labelled.where(border).select(*keys, "label").distinct()
    holes = _voxels_of(labelled.join(open_ones, [*keys, "label"], "left_anti"), keys)
    return dense.where(F.col(mask)).select(*keys, *XYZ).unionByName(holes)


def simple_mask(df: DataFrame, volumes: DataFrame, p: float = 10.0, keys: Sequence[str] = ("volume_id",),
                value: str = "value", groups: int | None = None) -> DataFrame:
    """Threshold, fill holes, erode once, dilate twice, keep the largest component."""
    dense = threshold_mask(df, p, keys, value, groups)
    filled = fill_holes(dense, volumes, keys, groups=groups)
    return largest_component(dilate(erode(filled, 1, keys), volumes, 2, keys, groups), keys)


def skull_strip(df: DataFrame, volumes: DataFrame, given: DataFrame | None = None,
                keys: Sequence[str] = ("volume_id",), value: str = "value", groups: int | None = None) -> DataFrame:
    """Multiplies by the given mask where a volume has one, else by its simple mask."""
    if given is None:
        return apply_mask(df, simple_mask(df, volumes, keys=keys, value=value, groups=groups), keys, value)
    have = given.select(*keys).distinct()
    rest = simple_mask(df.join(have, list(keys), "left_anti"), volumes, keys=keys, value=value, groups=groups)
    return apply_mask(df, given.select(*keys, *XYZ).unionByName(rest), keys, value)
