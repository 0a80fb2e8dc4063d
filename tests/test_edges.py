"""Edge cases: empty, flat, negative, NaN, infinite and tiny inputs, and wrong arguments."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import numpy_oracles as npo
from tests.volumes import cubes_of, heads, packed
from volumetry.config import Config, PreprocessConfig, SplitConfig
from volumetry.operators import augment, catalog, evaluate, grid, qc, splits, stats, tiles, tracking
from volumetry.operators.harmonize import HarmonizerModel
from volumetry.operators.normalize import normalize
from volumetry.operators.stats import histogram
from volumetry.schema import bricks, voxels

ODD = {
    0: np.zeros((2, 2, 2)), 1: np.full((2, 2, 2), 5.0), 2: -np.ones((2, 2, 2)),
    3: np.array([1, 2, np.nan, 4, 5, 6, 7, 8.0]).reshape(2, 2, 2),
    4: np.array([1, 2, np.inf, 4, 5, 6, 7, 8.0]).reshape(2, 2, 2), 5: np.array([[[3.0]]]),
}


def test_qc_of_odd_volumes(spark):
    got = {r["volume_id"]: r for r in qc.qc_metrics(packed(spark, ODD)).collect()}
    assert len(got) == len(ODD)
    assert got[0]["is_empty"] and got[0]["snr"] == 0 and got[0]["entropy"] == 0 and got[0]["mean_intensity"] == 0
    assert got[1]["snr"] == 0 and got[1]["entropy"] == pytest.approx(-2048.0) and not got[1]["is_empty"]
    assert got[2]["has_negative"] and got[2]["snr"] == 0
    assert got[3]["has_nan"] and math.isnan(got[3]["min_intensity"])
    assert got[4]["has_inf"] and not got[4]["has_nan"]
    assert got[5]["snr"] == 0 and not any(r["has_outliers"] for r in got.values())


def test_stats_of_odd_volumes(spark):
    got = {r["volume_id"]: r for r in stats.volume_stats(packed(spark, ODD)).collect()}
    assert got[0]["mean"] == 0 and got[0]["median"] == 0 and got[0]["p01"] is None
    assert got[1]["p99"] == 5 and got[5]["median"] == 3


@pytest.mark.parametrize("method", ["zscore", "minmax", "percentile"])
def test_normalize_leaves_empty_and_flat_volumes(spark, method):
    got = cubes_of(normalize(packed(spark, {i: ODD[i] for i in (0, 1, 2, 5)}), method=method))
    for i in (0, 1, 2, 5):
        np.testing.assert_allclose(got[i], ODD[i])


def test_unknown_methods_raise(spark):
    df = packed(spark, {0: ODD[1]})
    with pytest.raises(ValueError):
        normalize(df, method="median")
    with pytest.raises(ValueError):
        HarmonizerModel("other")
    with pytest.raises(ValueError):
        HarmonizerModel("zscore").transform(df)
    with pytest.raises(ValueError):
        qc.outlier_reasons(qc.qc_metrics(df), "mad")


def test_missing_reference_group(spark):
    df = packed(spark, {0: ODD[1]}).withColumn("field_strength", F.lit("7T"))
    with pytest.raises(ValueError):
        HarmonizerModel("histogram", "3T").fit(df)
    with pytest.raises(KeyError):
        HarmonizerModel("quantile", "3T").fit(df).transform(df)


@pytest.mark.parametrize("method", ["zscore", "quantile"])
def test_unknown_group_stays_unchanged(spark, method):
    known = packed(spark, {3: np.arange(1.0, 9).reshape(2, 2, 2)}).withColumn("field_strength", F.lit("3T"))
    other = packed(spark, {4: np.arange(2.0, 10).reshape(2, 2, 2)}).withColumn("field_strength", F.lit("unknown"))
    got = cubes_of(HarmonizerModel(method, "3T").fit(known).transform(other))
    np.testing.assert_allclose(got[4], np.arange(2.0, 10).reshape(2, 2, 2))


def test_reference_group_is_the_identity_of_quantiles(spark):
    df = packed(spark, {3: np.arange(1.0, 9).reshape(2, 2, 2)}).withColumn("field_strength", F.lit("3T"))
    np.testing.assert_allclose(cubes_of(HarmonizerModel("quantile", "3T").fit(df).transform(df))[3],
                               np.arange(1.0, 9).reshape(2, 2, 2))


def test_histogram_edges_match_numpy(spark):
    v = np.array([0.0, 1.0, 2.0, 3.0, 4.0, 4.0])
    df = spark.createDataFrame([(1, float(x)) for x in v], "g int, value double")
    got = {r["bin"]: r["n"] for r in histogram(df, ["g"], n=4, dense=True).collect()}
    assert [got[i] for i in range(4)] == np.histogram(v, 4)[0].tolist()


def test_more_folds_than_subjects(spark):
    df = spark.createDataFrame([(f"s{i}",) for i in range(3)], "subject string")
    assert {r["fold"] for r in splits.kfold_subjects(df, 5).collect()} == {4}


def test_folds_cover_all_subjects_once(spark):
    df = spark.createDataFrame([(f"s{i}",) for i in range(23)], "subject string")
    roles = splits.fold_roles(splits.kfold_subjects(df, 4), 4)
    val = roles.where("role = 'val'")
    assert val.count() == val.select("subject").distinct().count() == 23
    sizes = sorted(r["count"] for r in val.groupBy("fold").count().collect())
    assert sizes == [5, 5, 5, 8]


def test_ratio_and_config_checks(tmp_path):
    with pytest.raises(ValueError):
        Config(split=SplitConfig(train=0.5, val=0.2, test=0.2)).validate()
    with pytest.raises(ValueError):
        Config(preprocess=PreprocessConfig(normalization="x")).validate()
    with pytest.raises(ValueError):
        Config().with_root(str(tmp_path / "none")).validate(check_root=True)
    assert Config.highres().validate().preprocess.size == (256, 256, 256)
    assert Config.fast().preprocess.spacing == (2.0, 2.0, 2.0) and Config.default().batch_size == 2


def test_duplicate_and_missing_sessions(spark):
    df = spark.createDataFrame([("a", "T1w", "ses-1", "p1"), ("a", "T1w", "ses-1", "p2"), ("a", "T1w", "ses-2", "q"),
                                ("b", "T1w", "ses-1", "r")], "subject string, modality string, session string, path string")
    found = catalog.pair_sessions(df, "ses-1", "ses-2")
    assert catalog.paired(found).collect()[0]["input"] == "p2"
    lost = catalog.unpaired(found, "ses-1", "ses-2").collect()
    assert [(r["subject"], r["missing"]) for r in lost] == [("b", "ses-2")]


def test_patch_larger_than_volume(spark):
    pairs = spark.createDataFrame([(1, [2, 2, 2])], "pair_id long, shape array<int>")
    with pytest.raises(Exception, match="does not fit"):
        tiles.patch_origins(pairs, (3, 3, 3), 2).collect()
    assert tiles.patch_origins(pairs, (3, 3, 3), 2, pad=True).first()["x0"] == 0


def test_tile_grid_guards(spark):
    assert tiles.tile_grid(heads(spark, {0: ODD[0]}), (3, 3, 3)).count() == 0
    with pytest.raises(ValueError):
        tiles.strides((4, 4, 4), 0.9)


def test_identical_pair(spark):
    df = spark.createDataFrame([(1, i, 0, 0, float(i), float(i)) for i in range(4)],
                               "pair_id long, x int, y int, z int, a double, b double")
    assert evaluate.pair_metrics(df).first()["psnr"] == math.inf
    assert evaluate.batch_psnr(df, ["pair_id"]).first()["psnr"] == 0.0
    assert evaluate.ks_2samp(df).first()["ks_pvalue"] == 1.0


def test_flat_volume_counts_twice_as_saturated(spark):
    df = spark.createDataFrame([(1, i, 0, 0, 2.0, float(i)) for i in range(4)],
                               "pair_id long, x int, y int, z int, a double, b double")
    assert evaluate.consistency(df).first()["saturation_ratio"] == 2.0


def test_best_epoch_takes_the_first_minimum(spark):
    log = spark.createDataFrame([("m", e, v) for e, v in enumerate([3.0, 1.0, 1.0, 2.0])], "metric string, epoch int, value double")
    assert tracking.best_epoch(log).first()["best_epoch"] == 1
    assert [r["is_best"] for r in tracking.mark_best(log).orderBy("epoch").collect()] == [True, True, False, False]


def cube_pair(spark, a, b, side=64):
    df = packed(spark, {0: a, 1: b})
    whole = bricks(voxels(df), side=side)
    pairs = spark.createDataFrame([(0, 0, 1)], "pair_id long, input_id long, target_id long")
    return evaluate.pair_bricks(pairs, whole)


@pytest.mark.parametrize("side", [4, 64])
def test_pairs_of_unequal_grids_have_no_scores(spark, side):
    rng = np.random.default_rng(3)
    a, b = rng.random((8, 8, 8)), rng.random((8, 8, 6))
    both = cube_pair(spark, a, b, side)
    row = evaluate.pair_metrics(both).first()
    assert (row["shape_match"], row["l1"], row["mse"], row["psnr"]) == (False, None, None, None)
    assert evaluate.ssim(both, win=3, side=side).first()["ssim_a"] is None
    sides = evaluate.consistency(both).first()
    assert sides["a_mean"] == pytest.approx(a.mean()) and sides["b_mean"] == pytest.approx(b.mean())
    assert evaluate.ks_2samp(both).first()["ks_statistic"] <= 1


@pytest.mark.parametrize("side", [4, 64])
def test_similarity_of_nan_and_flat_volumes_is_nan(spark, side):
    rng = np.random.default_rng(4)
    a, b = rng.random((8, 8, 8)), rng.random((8, 8, 8))
    hole, flat = a.copy(), np.full((8, 8, 8), 2.0)
    hole[1, 2, 3] = np.nan
    assert math.isnan(evaluate.ssim(cube_pair(spark, hole, b, side), win=3, side=side).first()["ssim_a"])
    assert math.isnan(evaluate.ssim(cube_pair(spark, b, hole, side), win=3, side=side).first()["ssim_a"])
    assert math.isnan(evaluate.ssim(cube_pair(spark, flat, flat, side), win=3, side=side).first()["ssim_a"])


def test_smoothing_keeps_nan(spark):
    cube = np.ones((9, 9, 9))
    cube[4, 4, 4] = np.nan
    got = cubes_of(augment.rand_smooth(packed(spark, {0: cube}), p=1.1))[0]
    assert np.isnan(got[4, 4, 4]) and np.isfinite(got[0, 0, 0])


def test_a_generated_side_of_its_own(spark):
    rng = np.random.default_rng(5)
    a, b, g = (rng.random((6, 6, 6)) for _ in range(3))
    pairs = spark.createDataFrame([(0, 0, 1)], "pair_id long, input_id long, target_id long")
    both = evaluate.pair_bricks(pairs, packed(spark, {0: a, 1: b}), generated=packed(spark, {0: g}))
    row = evaluate.evaluate(both, win=3).first()
    assert row["l1_generated"] == pytest.approx(abs(g - b).mean())
    assert row["ssim_generated"] == pytest.approx(npo.ssim(g, b, 3), rel=1e-7)
    assert row["ssim_input"] == pytest.approx(npo.ssim(a, b, 3), rel=1e-7)


@pytest.mark.parametrize("side", [3, 64])
def test_middle_slices_over_bricks(spark, side):
    cube = np.random.default_rng(6).random((7, 6, 5))
    whole = bricks(voxels(packed(spark, {0: cube})), side=side)
    rows = grid.mid_slices(whole, heads(spark, {0: cube})).collect()
    for plane, axis in (("sagittal", 0), ("coronal", 1), ("axial", 2)):
        got = {(r["x"], r["y"], r["z"]): r["value"] for r in rows if r["plane"] == plane}
        want = {p: v for p, v in np.ndenumerate(cube) if p[axis] == cube.shape[axis] // 2}
        assert got == want


def test_masks_by_stems_of_several_lengths(spark):
    images = spark.createDataFrame(
        [("d", "a-1"), ("d", "a-12"), ("d", ""), ("d", None), ("e", "a-1")], "dir string, stem string")
    masks = spark.createDataFrame(
        [("d", "a-12_mask", "d/a-12"), ("d", "b", "d/b"), ("f", "a-1", "f/a-1")], "dir string, mask_name string, mask_path string")
    got = {(r["dir"], r["stem"]): (r["mask_path"], r["mask_match"]) for r in catalog.attach_masks(images, masks).collect()}
    assert got == {("d", "a-1"): ("d/a-12", "stem"), ("d", "a-12"): ("d/a-12", "stem"), ("d", ""): ("d/a-12", "folder"),
                   ("d", None): ("d/a-12", "folder"), ("e", "a-1"): (None, "none")}
