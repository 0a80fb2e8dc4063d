"""Grids pulled through one map against the same steps one by one, and what their plans move."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from volumetry.config import AugmentConfig, PreprocessConfig
from volumetry.operators import augment, grid, masks
from volumetry.plans.preprocess import preprocess
from volumetry.schema import bricks, voxels

R = np.random.default_rng(3)
CUBES = {1: R.normal(size=(7, 5, 9)), 2: R.normal(size=(4, 4, 4)), 3: R.normal(size=(1, 6, 3)), 4: R.normal(size=(11, 2, 5))}
CUBES[4][2, 1, 1] = np.nan
AXES = {1: "LAS", 2: "PSR", 3: "RAS", 4: "IPL"}


def tables(spark, side):
    rows = [(v, *map(int, p), float(c[p])) for v, c in CUBES.items() for p in np.ndindex(c.shape)]
    long = spark.createDataFrame(rows, "volume_id long, x int, y int, z int, value double")
    heads = spark.createDataFrame([(v, list(c.shape), [1.0, 0.5, 2.0], AXES[v]) for v, c in CUBES.items()],
                                  "volume_id long, shape array<int>, spacing array<double>, orientation string")
    return long, bricks(long, side=side), heads


def same(a, b):
    a, b = ({tuple(r)[:4]: r.value for r in voxels(df).select("volume_id", "x", "y", "z", "value").collect()} for df in (a, b))
    assert set(a) == set(b)
    for k, v in a.items():
        assert v == pytest.approx(b[k], abs=1e-9, nan_ok=True), k


@pytest.mark.parametrize("mode", ["trilinear", "nearest"])
@pytest.mark.parametrize("spacing, size", [(None, None), ((0.75, 0.6, 1.5), None), (None, (6, 6, 4)), ((2.0, 0.3, 0.7), (5, 12, 8))])
def test_one_map_equals_the_steps(spark, mode, spacing, size):
    long, packed, heads = tables(spark, 3)
    rows, at = grid.reorient(long.where("not isnan(value)" if mode == "trilinear" else "true"), heads, "RAS")
    if spacing:
        rows, at = grid.resample(rows, at, spacing, mode)
    if size:
        rows, at = grid.pad_or_crop(rows, at, size)
    got, now = grid.fitted(packed, heads, "RAS", spacing, mode, size, side=3)
    key = lambda df: sorted((r.volume_id, r.shape, r.spacing, r.orientation) for r in df.collect())
    assert key(at) == key(now)
    if mode == "trilinear":  # the steps drop a NaN sample's weight, the map keeps NaN
        rows, got = rows.where("volume_id < 4"), got.where("volume_id < 4")
    same(rows, got)
    assert got.where(F.size("value") != F.expr("dims[0] * dims[1] * dims[2]")).isEmpty()


def test_chain_of_packed_volumes(spark):
    long, packed, heads = tables(spark, 4)
    long, packed = (df.where("volume_id < 4").withColumn("value", v) for df, v in (
        (long, F.greatest(F.col("value") + 1, F.lit(0.0))), (packed, F.transform("value", lambda x: F.greatest(x + 1, F.lit(0.0))))))
    cfg = PreprocessConfig(spacing=(0.75, 0.75, 0.75), size=(8, 8, 8), normalization="percentile")
    want, _, _ = preprocess(long, heads.where("volume_id < 4"), cfg)
    got, at, found = preprocess(packed, heads.where("volume_id < 4"), cfg, side=4)
    same(want, got)
    assert {tuple(r.shape) for r in at.collect()} == {(8, 8, 8)} and found.count() == 3


def test_mask_of_bricks(spark):
    long, packed, _ = tables(spark, 3)
    inside = long.where("value > 0.3").select("volume_id", "x", "y", "z")
    same(masks.apply_mask(long.where("not isnan(value)"), inside),
         voxels(masks.apply_mask(packed, masks.packed_mask(inside, packed, 3))).where("not isnan(value)"))


def test_nothing_but_boxes_is_moved(spark):
    _, packed, heads = tables(spark, 3)
    cfg = AugmentConfig(affine_prob=1.1)
    for df in (augment.rand_affine(packed, heads, cfg, groups=4, side=3), grid.fitted(packed, heads, "RAS", (0.5, 0.5, 0.5), size=(9, 9, 9), groups=4, side=3)[0]):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        ops = re.findall(r"(?:MapInArrow|FlatMapGroupsInArrow|Generate|Aggregate|Join \w+)", plan)
        # unpacking may only follow the one grouping of boxes: no aggregate or join of samples above an explode of them
        assert ops.count("FlatMapGroupsInArrow") == 1
        above = plan[:plan.index("FlatMapGroupsInArrow")]
        assert "Aggregate" not in above and "Join" not in above


def test_far_turns_of_many_bricks(spark):
    """Half turns about every axis and large shifts, against the cube gathered at once."""
    _, packed, heads = tables(spark, 3)
    cfg = AugmentConfig(affine_prob=1.1, rotate=(3.0, 3.0, 3.0), translate=(6.0, 6.0, 6.0), scale=(0.5, 0.5, 0.5))
    same(augment.rand_affine(packed, heads, cfg, side=3), augment.rand_affine(packed, heads, cfg, side=64))


def test_empty(spark):
    _, packed, heads = tables(spark, 3)
    assert grid.fitted(packed.where("false"), heads, "RAS", size=(3, 3, 3))[0].count() == 0
    assert augment.rand_affine(packed.where("false"), heads).count() == 0
