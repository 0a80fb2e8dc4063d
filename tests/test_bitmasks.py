"""Bit-packed masks on many bricks against the operators on voxels, and what their plans move."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from volumetry.config import PreprocessConfig
from volumetry.operators import bitmasks, masks
from volumetry.plans.preprocess import preprocess, stripped
from volumetry.schema import bricks, voxels

R = np.random.default_rng(7)
SHAPES = {1: (9, 7, 8), 2: (3, 3, 3), 3: (1, 10, 2), 4: (6, 6, 6)}
CUBES = {v: R.normal(size=s) for v, s in SHAPES.items()}
CUBES[1][4, 3, 4] = np.nan
CUBES[4][:] = -1.0  # nothing is set
SIDE = 3


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(v, *map(int, p), float(c[p])) for v, c in CUBES.items() for p in np.ndindex(c.shape)]
    long = spark.createDataFrame(rows, "volume_id long, x int, y int, z int, value double").cache()
    heads = spark.createDataFrame([(v, list(s)) for v, s in SHAPES.items()], "volume_id long, shape array<int>")
    return long, bricks(long, side=SIDE).cache(), heads


def points(df):
    rows = [tuple(r) for r in df.select("volume_id", "x", "y", "z").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def inside(long, cut):
    return long.where((F.col("value") > cut) & ~F.isnan("value")).select("volume_id", "x", "y", "z")


@pytest.mark.parametrize("cut", [-0.8, 0.0, 0.9])
def test_same_as_on_voxels(tables, cut):
    long, packed, heads = tables
    bits, rows = bitmasks.above(packed, F.lit(cut)), inside(long, cut)
    assert points(bitmasks.set_voxels(bits)) == points(rows)
    for steps, want in (([("erode", 1)], masks.erode(rows)), ([("dilate", 2)], masks.dilate(rows, heads, 2)),
                        ([("dilate", 1), ("erode", 2)], masks.erode(masks.dilate(rows, heads, 1), 2))):
        assert points(bitmasks.set_voxels(bitmasks.morph(bits, heads, steps, side=SIDE))) == points(want), steps
    assert points(bitmasks.set_voxels(bitmasks.largest(bits, heads, side=SIDE))) == points(masks.largest_component(rows))
    dense = long.withColumn("in_mask", (F.col("value") > cut) & ~F.isnan("value"))
    assert points(bitmasks.set_voxels(bitmasks.filled(bits, heads, side=SIDE))) == points(masks.fill_holes(dense, heads))
    parts = bitmasks.components(bits, heads, side=SIDE).groupBy("volume_id", "label").agg(F.sum("n").alias("n"))
    want = masks.components(rows).groupBy("volume_id", "label").agg(F.sum(F.col("z1") - F.col("z0") + 1).alias("n"))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, want.collect()))


def test_holes_across_bricks(spark):
    """A shell of many bricks around an empty middle is filled; one with a way out is not."""
    shell = np.zeros((9, 9, 9))
    shell[1:8, 1:8, 1:8] = 1
    shell[2:7, 2:7, 2:7] = 0
    leaky = shell.copy()
    leaky[4, 4, 7] = 0
    rows = [(v, *map(int, p), float(c[p])) for v, c in ((1, shell), (2, leaky)) for p in np.ndindex(c.shape)]
    packed = bricks(spark.createDataFrame(rows, "volume_id long, x int, y int, z int, value double"), side=SIDE)
    heads = spark.createDataFrame([(1, [9, 9, 9]), (2, [9, 9, 9])], "volume_id long, shape array<int>")
    out = bitmasks.set_voxels(bitmasks.filled(bitmasks.above(packed, F.lit(0.5)), heads, side=SIDE)).groupBy("volume_id").count()
    assert {tuple(r) for r in out.collect()} == {(1, 343), (2, int(leaky.sum()))}


def test_simple_mask_and_strip(tables):
    long, packed, heads = tables
    up = long.withColumn("value", F.greatest(F.col("value") + 1.5, F.lit(0.0))).where("not isnan(value)")
    rows = bricks(long.withColumn("value", F.when(F.isnan("value"), 0.0).otherwise(F.greatest(F.col("value") + 1.5, F.lit(0.0)))), side=SIDE)
    flat = voxels(rows)
    assert points(bitmasks.set_voxels(bitmasks.simple(rows, heads, side=SIDE))) == points(masks.simple_mask(flat, heads))
    given = inside(up, 1.0).where("volume_id = 1")
    key = lambda df: {tuple(r)[:4]: r.value for r in voxels(df).select("volume_id", "x", "y", "z", "value").collect()}
    assert key(stripped(rows, heads, given, side=SIDE)) == key(masks.skull_strip(flat, heads, given))


def test_planes_and_bits_alone_are_moved(tables, spark):
    """No exchange of the chain of mask steps has a row for a voxel: nothing is unpacked below one."""
    _, packed, heads = tables
    packed = spark.createDataFrame(packed.collect(), packed.schema)
    out = bitmasks.morph(bitmasks.above(packed, F.lit(0.0)), heads, [("erode", 1), ("dilate", 2)], groups=4, side=SIDE)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("FlatMapGroupsInArrow") == 1 and "Aggregate" not in plan


def test_refused_and_empty(tables, spark):
    _, packed, heads = tables
    bits = bitmasks.above(packed, F.lit(0.0))
    with pytest.raises(ValueError):
        bitmasks.morph(bits, heads, [("dilate", SIDE + 1)], side=SIDE)
    with pytest.raises(ValueError):
        bitmasks.morph(bits, heads, [("open", 1)], side=SIDE)
    none = bits.where("false")
    for made in (bitmasks.morph(none, heads, [("erode", 1)], side=SIDE), bitmasks.largest(none, heads, side=SIDE), bitmasks.filled(none, heads, side=SIDE)):
        assert made.count() == 0
    assert bitmasks.set_voxels(none).count() == 0


def test_labels_of_a_winding_path():
    mask = np.zeros((5, 5, 5), bool)
    path = [(0, y, 0) for y in range(5)] + [(x, 4, 0) for x in range(5)] + [(4, 4, z) for z in range(5)] + [(4, y, 4) for y in range(5)]
    for p in path:
        mask[p] = True
    mask[2, 0, 0] = True
    found = bitmasks.labels(mask, (10, 20, 30))
    assert len({found[p] for p in path}) == 1 and found[2, 0, 0] != found[0, 0, 0] and (found[~mask] == -1).all()
    assert found[0, 0, 0] == (10 << 42) + (20 << 21) + 30


def test_chain_uses_them(tables):
    long, packed, heads = tables
    heads = heads.withColumns({"spacing": F.array(*[F.lit(1.0)] * 3), "orientation": F.lit("LAS")}).where("volume_id in (1, 2)")
    rows = bricks(long.where("volume_id in (1, 2)").withColumn("value", F.when(F.isnan("value"), 0.0).otherwise(F.greatest(F.col("value") + 1.5, F.lit(0.0)))), side=SIDE)
    cfg = PreprocessConfig(spacing=(0.8, 0.8, 0.8))
    key = lambda df: {tuple(r)[:4]: round(r.value, 8) for r in voxels(df).select("volume_id", "x", "y", "z", "value").collect()}
    assert key(preprocess(rows, heads, cfg, side=SIDE)[0]) == key(preprocess(voxels(rows), heads, cfg)[0])
