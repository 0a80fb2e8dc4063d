"""Operators on small random volumes against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import numpy_oracles as npo
from tests.volumes import cubes_of, heads, mask_rows, packed, random_cubes
from volumetry.config import AugmentConfig
from volumetry.functions.hashing import between
from volumetry.operators import augment, evaluate, grid, masks, ordering, qc, stats, tiles
from volumetry.operators.harmonize import HarmonizerModel
from volumetry.operators.normalize import normalize
from volumetry.schema import bricks, voxels

CUBES = random_cubes()


def near(got, want, tol=1e-6):
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=tol, atol=tol)


def test_percentiles_match_numpy_on_awkward_values(spark):
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(0, 1, 5001), "outlier": np.append(rng.normal(1000, 1, 4000), [1e30, -1e30]),
        "narrow": 1000 + rng.random(3000) * 1e-9, "ties": rng.integers(0, 3, 1000).astype(float),
        "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "flat": np.full(10, 3.0),
    }
    df = spark.createDataFrame([(k, float(v)) for k, a in groups.items() for v in a], "g string, v double")
    ps = [0.0, 0.5, 25.0, 50.0, 99.5, 100.0]
    for bound in (None, len(groups)):
        got = {r["g"]: r["pct"] for r in ordering.percentiles(df, ["g"], "v", ps, groups=bound).collect()}
        for k, a in groups.items():
            np.testing.assert_allclose(got[k], np.percentile(a, ps), rtol=1e-12)
    whole = ordering.percentiles(df, [], "v", ps).first()["pct"]
    np.testing.assert_allclose(whole, np.percentile(np.concatenate(list(groups.values())), ps), rtol=1e-12)


@pytest.mark.parametrize("keys", [["g"], []])
def test_uneven_values_are_cut_until_every_interval_is_small(spark, monkeypatch, keys):
    """Values the first cut can't tell apart: one far outlier, a narrow cluster, one value in most rows, tiny numbers."""
    rng = np.random.default_rng(8)
    groups = {
        "uniform": rng.random(4000), "lognormal": rng.lognormal(0, 4, 4000),
        "cluster": np.append(1e12 + rng.random(4000), [-1e300]), "hot": np.append(np.full(3000, 2.5), 2.5 + rng.random(1500) * 1e-12),
        "tiny": np.append(rng.lognormal(-300, 20, 3000), 1e10),
    }
    df = spark.createDataFrame([(k, float(v)) for k, a in groups.items() for v in a], "g string, v double").repartition(6)
    monkeypatch.setattr(ordering, "CELL_ROWS", 40)
    parts, sizes = ordering.cut_lineage, []

    def seen(table, name="stage"):
        out = parts(table, name)
        if name == "steps":
            sizes.append(out.where("_open").agg({"_c": "max"}).first()[0])
        return out

    monkeypatch.setattr(ordering, "cut_lineage", seen)
    ps = [0.0, 1.0, 33.3, 50.0, 75.0, 99.0, 100.0]
    got = {r["g"] if keys else None: (r["n"], r["pct"]) for r in ordering.percentiles(df, keys, "v", ps).collect()}
    want = groups if keys else {None: np.concatenate(list(groups.values()))}
    for g, a in want.items():
        assert got[g][0] == len(a)
        np.testing.assert_allclose(got[g][1], np.percentile(a, ps), rtol=1e-12)
    assert sizes[0] > 1000 and (sizes[-1] or 0) <= 40


@pytest.mark.parametrize("rows", [30, 100_000])
def test_ks_opens_few_intervals(spark, monkeypatch, rows):
    monkeypatch.setattr(ordering, "CELL_ROWS", rows)
    rng = np.random.default_rng(9)
    sides = {0: (rng.normal(0, 1, 6000), rng.normal(0.1, 1, 6000)), 1: (rng.lognormal(0, 3, 6000), rng.lognormal(0.3, 3, 6000)),
             2: (np.round(rng.random(6000), 2), np.round(rng.random(6000), 2)), 3: (np.full(6000, 1.0), np.full(6000, 2.0))}
    df = spark.createDataFrame([(p, 0, 0, i, float(x), float(y)) for p, (a, b) in sides.items() for i, (x, y) in enumerate(zip(a, b))],
                               "pair_id int, x int, y int, z int, a double, b double")
    got = {r["pair_id"]: r for r in evaluate.ks_2samp(df, groups=4, report=True).collect()}
    for p, (a, b) in sides.items():
        every = np.union1d(a, b)
        gap = abs(np.searchsorted(np.sort(a), every, "right") - np.searchsorted(np.sort(b), every, "right")).max() / 6000
        assert got[p]["ks_statistic"] == pytest.approx(gap, abs=1e-12)
        assert got[p]["n_samples"] == 12_000 and got[p]["n_opened"] < 3000


def test_contrast_opens_only_the_ends_of_its_bands(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CELL_ROWS", 25)
    rng = np.random.default_rng(10)
    cubes = {1: rng.normal(500, 90, 5000), 2: np.round(rng.lognormal(3, 1, 5000)), 3: np.full(5000, 4.0)}
    masks = {i: rng.random(5000) < 0.7 for i in cubes}
    df = spark.createDataFrame([(i, float(v), bool(m)) for i in cubes for v, m in zip(cubes[i], masks[i])],
                               "volume_id int, value double, in_mask boolean")
    got = {r["volume_id"]: r["cnr"] for r in qc.cnr(df).collect()}
    for i in cubes:
        assert got[i] == pytest.approx(npo.cnr(cubes[i], masks[i]))


def test_approximate_percentiles_are_close(spark):
    a = np.random.default_rng(2).normal(0, 1, 20000)
    df = spark.createDataFrame([(1, float(v)) for v in a], "g int, v double")
    got = ordering.percentiles(df, ["g"], "v", [50.0], exact=False).first()["pct"][0]
    assert abs(got - np.median(a)) < 0.01


def test_volume_stats(spark):
    for r in stats.volume_stats(packed(spark, CUBES)).collect():
        v = CUBES[r["volume_id"]]
        v = v[v != 0]
        want = [v.mean(), v.std(), v.min(), v.max(), np.median(v), *np.percentile(v, [1, 99])]
        np.testing.assert_allclose([r[c] for c in ("mean", "std", "min", "max", "median", "p01", "p99")], want, rtol=1e-9)


def test_qc_metrics(spark):
    got = {r["volume_id"]: r for r in qc.qc_metrics(packed(spark, CUBES)).collect()}
    for i, v in CUBES.items():
        assert got[i]["snr"] == pytest.approx(npo.snr(v), rel=1e-6)
        assert got[i]["entropy"] == pytest.approx(npo.entropy(v), rel=1e-9)
        assert got[i]["foreground_fraction"] == pytest.approx((v != 0).mean())


def test_qc_with_mask(spark):
    inside = F.col("x").between(1, 4) & F.col("y").between(1, 4)
    rows = qc.with_mask(packed(spark, CUBES), inside)
    got = {r["volume_id"]: r for r in qc.qc_metrics(rows, mask="in_mask").collect()}
    for i, v in CUBES.items():
        m = np.zeros(v.shape, bool)
        m[1:5, 1:5, :] = True
        assert got[i]["snr"] == pytest.approx(npo.snr(v, m)) and got[i]["cnr"] == pytest.approx(npo.cnr(v, m))


@pytest.mark.parametrize("method", ["zscore", "minmax", "percentile"])
def test_normalize(spark, method):
    near(cubes_of(normalize(packed(spark, CUBES), method=method)), {i: npo.normalize(v, method) for i, v in CUBES.items()})


def test_normalize_with_mask_has_zero_mean_and_unit_std(spark):
    rows = voxels(packed(spark, CUBES)).withColumn("in_mask", F.col("x") > 1)
    got = cubes_of(normalize(rows, mask="in_mask"))
    for i, v in CUBES.items():
        m = np.zeros(v.shape, bool)
        m[2:] = True
        np.testing.assert_allclose(got[i], npo.normalize(v, mask=m), rtol=1e-8, atol=1e-8)
        assert abs(got[i][m].mean()) < 1e-9 and got[i][m].std() == pytest.approx(1.0)


def grouped(spark):
    names = {0: "3T", 1: "7T", 2: "7T"}
    label = F.when(F.col("volume_id") == 0, "3T").otherwise("7T")
    return packed(spark, CUBES).withColumn("field_strength", label), names


def pool(names, which):
    v = np.concatenate([CUBES[i].ravel() for i, n in names.items() if n == which])
    return v[v > 0]


def test_quantile_harmonisation(spark):
    rows, names = grouped(spark)
    got = cubes_of(HarmonizerModel("quantile", "3T").fit(rows).transform(rows))
    near(got, {i: npo.quantile_map(v, pool(names, names[i]), pool(names, "3T")) for i, v in CUBES.items()})


def test_histogram_harmonisation(spark):
    rows, names = grouped(spark)
    got = cubes_of(HarmonizerModel("histogram", "3T", bins=16).fit(rows).transform(rows))
    np.testing.assert_allclose(got[0], CUBES[0])
    for i in (1, 2):
        np.testing.assert_allclose(got[i], npo.histogram_map(CUBES[i], pool(names, "3T"), 16), rtol=1e-7)


def pair_table(spark):
    return spark.createDataFrame([(0, 0, 1), (1, 1, 2)], "pair_id long, input_id long, target_id long")


def test_pair_scores(spark):
    packed_pairs = evaluate.pair_bricks(pair_table(spark), packed(spark, CUBES))
    metrics = {r["pair_id"]: r for r in evaluate.pair_metrics(packed_pairs).collect()}
    sim = {r["pair_id"]: r["ssim_a"] for r in evaluate.ssim(packed_pairs, win=5).collect()}
    # the same through bricks of side 3 that exchange halos, with a generated side
    cut = evaluate.ssim(evaluate.pair_voxels(packed_pairs), generated=lambda a, b: (a + b) / 2, win=5, side=3)
    halo = {r["pair_id"]: r for r in cut.collect()}
    for p in (0, 1):
        a, b = CUBES[p], CUBES[p + 1]
        mse = ((a - b) ** 2).mean()
        assert metrics[p]["l1"] == pytest.approx(abs(a - b).mean())
        assert metrics[p]["psnr"] == pytest.approx(10 * np.log10((b.max() - b.min()) ** 2 / mse))
        assert sim[p] == pytest.approx(npo.ssim(a, b, 5), rel=1e-7)
        assert halo[p]["ssim_a"] == pytest.approx(sim[p], rel=1e-7)
        assert halo[p]["ssim_g"] == pytest.approx(npo.ssim((a + b) / 2, b, 5), rel=1e-7)


def test_ks_statistic(spark):
    got = {r["pair_id"]: r for r in evaluate.ks_2samp(evaluate.pair_bricks(pair_table(spark), packed(spark, CUBES))).collect()}
    for p in (0, 1):
        a, b = np.sort(CUBES[p].ravel()), np.sort(CUBES[p + 1].ravel())
        every = np.union1d(a, b)
        gap = abs(np.searchsorted(a, every, "right") / len(a) - np.searchsorted(b, every, "right") / len(b)).max()
        assert got[p]["ks_statistic"] == pytest.approx(gap) and 0 <= got[p]["ks_pvalue"] <= 1


def test_tiles(spark):
    h = heads(spark, CUBES)
    got = cubes_of(tiles.tiled_apply(packed(spark, CUBES), h, tiles.demean(), (4, 4, 4), 0.5))
    near(got, {i: npo.tiled_demean(v, 4, 2) for i, v in CUBES.items()})
    near(cubes_of(tiles.tiled_apply(packed(spark, CUBES), h, tiles.identity, (4, 4, 4), 0.5)), CUBES)
    for side in (3, 64):  # several bricks, and tiles across them
        df = bricks(voxels(packed(spark, CUBES)), side=side)
        near(cubes_of(voxels(tiles.tiled_model(df, h, lambda cube: cube - cube.mean(), (4, 4, 4), 0.5, side=side))), got)


def test_resample_matches_interpolation(spark):
    new = (0.7, 1.3, 2.0)
    out, head = grid.resample(packed(spark, CUBES), heads(spark, CUBES), new)
    shape = head.first()["shape"]
    idx = np.stack(np.meshgrid(*[np.arange(n) for n in shape], indexing="ij"), axis=-1) * np.array(new)
    near(cubes_of(out), {i: npo.trilinear(v, idx) for i, v in CUBES.items()})


def test_pad_and_crop(spark):
    out, _ = grid.pad_or_crop(packed(spark, CUBES), heads(spark, CUBES), (9, 3, 5))
    want = {i: np.pad(v[:, 2:5, :], ((1, 1), (0, 0), (0, 0))) for i, v in CUBES.items()}
    near(cubes_of(out), want)


def sets(m):
    return {tuple(int(c) for c in p) for p in zip(*np.nonzero(m))}


@pytest.mark.parametrize("seed", [3, 4])
def test_mask_pipeline(spark, seed):
    cubes = random_cubes(2, (8, 7, 9), seed)
    h = heads(spark, cubes)
    dense = masks.threshold_mask(packed(spark, cubes), 40.0)
    on = {i: v > np.percentile(v[v > 0], 40.0) for i, v in cubes.items()}
    assert mask_rows(dense.where("in_mask")) == {i: sets(m) for i, m in on.items()}
    assert mask_rows(masks.fill_holes(dense, h)) == {i: sets(npo.fill_holes(m)) for i, m in on.items()}
    assert mask_rows(masks.largest_component(dense.where("in_mask"))) == {i: sets(npo.largest(m)) for i, m in on.items()}
    for side in (2, 3, 64):  # many bricks or one
        labels = masks.components(dense.where("in_mask"), side=side).groupBy("volume_id").agg(F.countDistinct("label")).collect()
        assert {r[0]: r[1] for r in labels} == {i: npo.label(m).max() for i, m in on.items()}
    got = mask_rows(masks.simple_mask(packed(spark, cubes), h))
    want = {i: sets(npo.simple_mask(v)) for i, v in cubes.items()}
    assert got == {i: s for i, s in want.items() if s}


def test_long_thin_component_settles(spark):
    """A snake through the grid is one component, however long."""
    m = np.zeros((9, 9, 9), bool)
    m[::2, :, 4] = True
    m[1::4, 8, 4] = True
    m[3::4, 0, 4] = True
    rows = spark.createDataFrame([(1, *p) for p in sets(m)], "volume_id long, x int, y int, z int")
    labelled = masks.components(rows, side=2)
    assert labelled.select("label").distinct().count() == 1 == npo.label(m).max()


@pytest.mark.parametrize("form", ["packed", "bricks"])
def test_smooth(spark, form):
    df = packed(spark, CUBES)
    got = cubes_of(augment.rand_smooth(df if form == "packed" else voxels(df), p=1.1, side=64 if form == "packed" else 6))
    ids = spark.createDataFrame([(i,) for i in CUBES], "volume_id long")
    for r in ids.select("volume_id", *[between(0.5, 1.5, 42, F.col("volume_id"), "smooth", c).alias(c) for c in "xyz"]).collect():
        np.testing.assert_allclose(got[r[0]], npo.smooth(CUBES[r[0]], (r["x"], r["y"], r["z"])), rtol=1e-5, atol=1e-4)


def test_affine(spark):
    cfg = AugmentConfig(affine_prob=1.1, translate=(1.0, 1.0, 1.0))
    got = cubes_of(augment.rand_affine(packed(spark, CUBES), heads(spark, CUBES), cfg))
    ids = spark.createDataFrame([(i,) for i in CUBES], "volume_id long")
    names = [(n, c) for n in ("rotate", "move", "size") for c in "xyz"]
    size = {"rotate": 0.1, "move": 1.0, "size": 0.1}
    drawn = ids.select("volume_id", *[between(-size[n], size[n], 42, F.col("volume_id"), "affine", n + c).alias(n + c) for n, c in names])
    for r in drawn.collect():
        (cx, sx), (cy, sy), (cz, sz) = [(np.cos(r["rotate" + c]), np.sin(r["rotate" + c])) for c in "xyz"]
        turn = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]) @ np.array(
            [[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]) @ np.diag([1 + r["size" + c] for c in "xyz"])
        v = CUBES[r[0]]
        mid = (np.array(v.shape) - 1) / 2
        idx = np.stack(np.meshgrid(*[np.arange(n) for n in v.shape], indexing="ij"), axis=-1) - mid
        pos = idx @ turn.T + np.array([r["move" + c] for c in "xyz"]) + mid
        np.testing.assert_allclose(got[r[0]], npo.trilinear(v, pos), rtol=1e-7, atol=1e-7)


def test_rot90_matches_numpy(spark):
    cubes = random_cubes(6, (3, 3, 2), 9)
    got = cubes_of(augment.rand_rot90(packed(spark, cubes), heads(spark, cubes), p=1.1))
    for i, v in cubes.items():
        assert any(np.allclose(got[i], np.rot90(v, k)) for k in (1, 2, 3))


def test_rot90_headers_follow_the_samples(spark):
    cubes = random_cubes(6, (3, 4, 2), 9)
    h = heads(spark, cubes)
    got = cubes_of(augment.rand_rot90(packed(spark, cubes), h, p=1.1))
    shapes = {r[0]: tuple(r[1]) for r in augment.rot90_headers(h, p=1.1).select("volume_id", "shape").collect()}
    assert shapes == {i: v.shape for i, v in got.items()}


def test_affine_moves_both_sides_together(spark):
    rows = voxels(packed(spark, CUBES)).withColumnRenamed("value", "a").withColumn("b", F.col("a") * 2)
    cfg = AugmentConfig(affine_prob=1.1)
    out = augment.rand_affine(rows, heads(spark, CUBES), cfg, value="a", also=("b",))
    assert out.count() == sum(c.size for c in CUBES.values())
    assert out.where(F.abs(F.col("b") - 2 * F.col("a")) > 1e-9).isEmpty()


def test_qc_of_a_cohort_where_some_masks_are_missing(spark):
    rows = qc.with_mask(packed(spark, CUBES), F.when(F.col("volume_id") > 0, F.col("x") > 2))
    got = {r["volume_id"]: r for r in qc.qc_metrics(rows, mask="in_mask").collect()}
    assert not got[0]["has_mask"] and got[1]["has_mask"] and got[0]["cnr"] == 0
    assert got[0]["snr"] == pytest.approx(npo.snr(CUBES[0]), rel=1e-6)
