"""Real files: discovery, sidecars, decoding, sinks and incremental intake."""

import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from volumetry.config import CohortConfig, PreprocessConfig
from volumetry.operators import catalog, qc, stats
from volumetry.operators.harmonize import HarmonizerModel
from volumetry.plans.preprocess import preprocess
from volumetry.plans.queries.storage import file_bytes
from volumetry.schema import voxels
from volumetry.sinks import report, writers
from volumetry.sources import cohort, volumes
from volumetry.streaming.intake import stream_qc
from tests.volumes import heads, packed, random_cubes

RNG = np.random.default_rng(5)


def put(root, subject, session, modality, cube, sidecar=None):
    folder = root / subject / session / "anat"
    folder.mkdir(parents=True, exist_ok=True)
    stem = f"{subject}_{session}_{modality}"
    (folder / f"{stem}_defaced.nii.gz").write_bytes(gzip.compress(file_bytes(cube)))
    if sidecar is not None:
        (folder / f"{stem}.json").write_text(sidecar)
    return cube.astype("f4")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("cohort")
    cubes = {}
    for s in ("sub-01", "sub-02"):
        for ses in ("ses-1", "ses-2"):
            for m in ("T1w", "T2w"):
                side = json.dumps({"EchoTime": 0.5, "who": s}) if m == "T1w" else "{broken"
                cubes[(s, ses, m)] = put(root, s, ses, m, np.maximum(RNG.normal(5, 3, (5, 4, 3)), 0), side)
    put(root, "sub-03", "ses-9", "T1w", np.ones((2, 2, 2)))
    put(root, "sub-03", "ses-1", "FLAIR", np.ones((2, 2, 2)))
    (root / "notes.txt").write_text("not a volume")
    (root / "sub-01" / "stray_T1w_defaced.nii.gz").write_bytes(b"x")
    return root, cubes


def test_discovery(spark, tree):
    root, cubes = tree
    cat = cohort.discover(spark, str(root))
    rows = {(r["subject"], r["session"], r["modality"]): r for r in cat.collect()}
    assert set(rows) == set(cubes) | {("sub-03", "ses-9", "T1w")}
    assert rows[("sub-01", "ses-1", "T1w")]["field_strength"] == "3T"
    assert rows[("sub-01", "ses-2", "T1w")]["field_strength"] == "7T"
    assert rows[("sub-03", "ses-9", "T1w")]["field_strength"] == "unknown"
    assert "content" not in cat._jdf.queryExecution().executedPlan().toString()


def test_sidecars(spark, tree):
    root, _ = tree
    got = cohort.attach_sidecars(spark, cohort.discover(spark, str(root)), str(root)).select(
        "subject", "modality", F.try_variant_get("metadata", "$.who", "string").alias("who"),
        F.to_json("metadata").alias("text")).collect()
    assert len(got) == 9
    for r in got:
        assert r["who"] == (r["subject"] if r["modality"] == "T1w" and r["subject"] != "sub-03" else None)
        assert r["who"] or r["text"] == "{}"


def test_decoding(spark, tree):
    root, cubes = tree
    cat = cohort.discover(spark, str(root))
    decoded = volumes.load_volumes(spark, str(root), cat)
    assert volumes.failures_of(decoded).count() == 0
    ids = {r["volume_id"]: (r["subject"], r["session"], r["modality"]) for r in cat.collect()}
    seen = {}
    for r in voxels(volumes.bricks_of(decoded)).collect():
        seen.setdefault(ids[r["volume_id"]], {})[(r["x"], r["y"], r["z"])] = r["value"]
    for key, cube in cubes.items():
        assert seen[key] == {tuple(p): v for p, v in np.ndenumerate(cube)}
    assert volumes.headers_of(decoded).where("volume_id = %d" % next(i for i, k in ids.items() if k in cubes)).first()["shape"] == [5, 4, 3]


def test_decoder_variants():
    cube = np.arange(24, dtype="f4").reshape(2, 3, 4)
    head, got = volumes.decode(file_bytes(cube))
    np.testing.assert_array_equal(got, cube)
    assert head["affine"][0] == [1.0, 0.0, 0.0, 0.0]
    series = np.stack([cube, cube + 100], axis=-1)
    np.testing.assert_array_equal(volumes.decode(file_bytes(series))[1], cube)
    scaled = bytearray(file_bytes(cube))
    struct.pack_into("<2f", scaled, 112, 2.0, 1.0)
    np.testing.assert_array_equal(volumes.decode(bytes(scaled))[1], cube * 2 + 1)
    for bad in (b"", b"short", bytes(400), file_bytes(cube)[:-8]):
        with pytest.raises(ValueError):
            volumes.decode(bad)


def test_split_metric_and_report_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s1", "train"), (2, "s2", "val")], "volume_id long, subject string, split string")
    writers.write_split(rows, str(tmp_path / "split"))
    back = writers.read_split(spark, str(tmp_path / "split"), "volume_id long, subject string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    found = qc.qc_metrics(packed(spark, random_cubes(4)))
    flagged = qc.flag_outliers(found, qc.detect_outliers(found))
    writers.write_metrics(flagged, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4
    lines = report.qc_report(flagged, qc.qc_summary(flagged), stats.describe_exact(found, ["snr", "entropy"]))
    report.write_report(lines, str(tmp_path / "html"))
    page = "".join(p.read_text() for p in sorted((tmp_path / "html").glob("part-*")))
    assert page.startswith("<html>") and page.rstrip().endswith("</html>") and page.count("<tr") >= 4 + 2
    writers.write_eval(found.withColumnRenamed("volume_id", "subject"), str(tmp_path / "eval"))
    assert spark.read.option("header", True).csv(str(tmp_path / "eval")).columns[0] == "subject"


@pytest.mark.parametrize("method", ["histogram", "zscore", "quantile"])
def test_model_files(spark, tmp_path, method):
    rows = packed(spark, random_cubes(2)).withColumn("field_strength", F.when(F.col("volume_id") == 0, "3T").otherwise("7T"))
    model = HarmonizerModel(method, "3T").fit(rows)
    model.save(str(tmp_path / "model"))
    again = HarmonizerModel.load(spark, str(tmp_path / "model"))
    key = lambda r: (r["volume_id"], r["x"], r["y"], r["z"])
    a, b = [sorted(((*key(r), r["value"]) for r in m.transform(rows).collect())) for m in (model, again)]
    assert a == b and again.method == method


def test_brick_table_prunes_folders(spark, tmp_path):
    rows = packed(spark, random_cubes(2)).withColumns({"modality": F.lit("T1w"), "session": F.lit("ses-1")})
    writers.write_bricks(rows, str(tmp_path / "bricks"))
    plan = spark.read.parquet(str(tmp_path / "bricks")).where("modality = 'T1w'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(modality" in plan


def test_masked_chain_keeps_volumes(spark):
    cubes = random_cubes(2, (6, 6, 6))
    identity = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]
    vols = heads(spark, cubes).withColumns({"orientation": F.lit("RAS"), "affine": F.array(*[
        F.array(*[F.lit(float(v)) for v in r]) for r in identity])})
    out, head, found = preprocess(packed(spark, cubes), vols, PreprocessConfig(spacing=(2.0, 2.0, 2.0), size=(4, 4, 4)))
    assert out.count() == 2 * 64 and found.count() == 2 and head.first()["shape"] == [4, 4, 4]


def test_intake_takes_each_file_once(spark, tmp_path):
    root, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    put(tmp_path / "in", "sub-01", "ses-1", "T1w", RNG.random((3, 3, 3)) + 1)
    put(tmp_path / "in", "sub-01", "ses-2", "T1w", RNG.random((3, 3, 3)) + 1)
    for _ in range(2):  # the second run finds nothing new
        stream_qc(spark, root, out, mark).awaitTermination()
    first = spark.read.parquet(f"{out}/metrics")
    assert first.count() == first.select("volume_id").distinct().count() == 2
    put(tmp_path / "in", "sub-02", "ses-1", "T1w", RNG.random((3, 3, 3)) + 1)
    bad = tmp_path / "in" / "sub-02" / "ses-2" / "anat"
    bad.mkdir(parents=True)
    (bad / "sub-02_ses-2_T1w_defaced.nii.gz").write_bytes(b"broken")
    stream_qc(spark, root, out, mark).awaitTermination()
    got = spark.read.parquet(f"{out}/metrics")
    assert got.count() == got.select("volume_id").distinct().count() == 3
    assert spark.read.parquet(f"{out}/failures").count() == 1


def test_pending_work(spark):
    cat = spark.createDataFrame([("a",), ("b",)], "path string")
    done = spark.createDataFrame([("a",)], "path string")
    assert [r["path"] for r in catalog.pending(cat, done, ["path"]).collect()] == ["b"]
    assert CohortConfig().file_pattern.endswith(catalog.DEFACED_FILE)


def test_files_are_python_bytes_one_at_a_time(spark):
    """No frame of a whole batch of contents: files go through Arrow, null ones and broken ones as rows with an error."""
    files = spark.createDataFrame([(1, None), (2, bytearray(b"short")), (None, bytearray(400))], "volume_id long, content binary")
    out = volumes.decode_volumes(files)
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    found = {r.volume_id: r.error for r in out.collect()}
    assert found[1].startswith("TypeError") and "shorter than a header" in found[2] and "not a NIfTI-1" in found[None]
