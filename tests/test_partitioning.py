"""Results do not depend on partitions; hot groups stay exact and unsorted as a whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.volumes import heads, packed, random_cubes
from volumetry.config import AugmentConfig
from volumetry.operators import augment, ordering, splits
from volumetry.functions.hashing import digest

PARTS = (1, 4, 17)


def same(results):
    first = results[0]
    return all(r == first for r in results)


def test_split_and_batches(spark):
    df = spark.createDataFrame([(f"s{i}",) for i in range(500)], "subject string")
    assert same([sorted(map(tuple, splits.split_subjects(df.repartition(n)).collect())) for n in PARTS])
    assert same([sorted(map(tuple, splits.to_batches(df.repartition(n), 7, "subject").collect())) for n in PARTS])


def test_split_keeps_most_subjects_when_one_is_added(spark):
    df = spark.createDataFrame([(f"s{i}",) for i in range(300)], "subject string")
    before = dict(map(tuple, splits.split_subjects(df).collect()))
    after = dict(map(tuple, splits.split_subjects(df.union(spark.createDataFrame([("new",)], "subject string"))).collect()))
    assert sum(before[s] != after[s] for s in before) <= 2


def test_augmentation(spark):
    cubes = random_cubes(4)
    cfg = AugmentConfig(dropout_prob=0.5, dropout_side=(1, 3))
    h = heads(spark, cubes)
    runs = [sorted((r["volume_id"], r["x"], r["y"], r["z"], round(r["value"], 9)) for r in
                   augment.augment(packed(spark, cubes).repartition(n), h, cfg).collect()) for n in PARTS]
    assert same(runs)


def test_disabled_augmentation_is_the_identity(spark):
    cubes = random_cubes(2)
    out = augment.augment(packed(spark, cubes), heads(spark, cubes), AugmentConfig(enabled=False))
    assert out.count() == sum(c.size for c in cubes.values())
    assert {(r["volume_id"], r["x"], r["y"], r["z"]): r["value"] for r in out.collect()} == {
        (i, *p): float(v) for i, c in cubes.items() for p, v in np.ndenumerate(c)}


@pytest.fixture(scope="module")
def hot(spark):
    """One group holds a third of all rows, and half of those are one value."""
    base = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("g"),
        F.when(F.col("id") % 6 == 0, 5.0).otherwise((F.col("id") * 7919 % 10_007) / 3.0).alias("v"), "id")
    return base


def test_hot_group_percentiles(spark, hot):
    got = {r["g"]: r["pct"] for r in ordering.percentiles(hot, ["g"], "v", [1.0, 50.0, 99.0]).collect()}
    pdf = hot.toPandas()
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got[g], np.percentile(part["v"], [1, 50, 99]))


def test_hot_group_sample_is_exact(spark, hot):
    got = ordering.hash_sample(hot, digest(1, F.col("id")), ["id"], 3000, ["g"]).groupBy("g").count().collect()
    sizes = {r["g"]: r["count"] for r in hot.groupBy("g").count().collect()}
    assert {r["g"]: r["count"] for r in got} == {g: min(n, 3000) for g, n in sizes.items()}


def test_no_window_orders_a_whole_group(spark, hot):
    """Windows inside the percentile plan run over cells and counts, never over samples of a group."""
    plan = ordering.percentiles(hot, ["g"], "v", [50.0])._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "windowspecdefinition" in line:
            assert "_cell" in line or "sum(_c" in line


def test_order_by_a_key_that_fills_a_third_of_all_rows(spark):
    from volumetry.operators.splits import range_rank

    df = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(
        F.exp((F.col("id") * 31 % 9000) / 50.0)).alias("k")).repartition(7)
    got = [(r["k"], r["rn"]) for r in range_rank(df, "k").orderBy("rn").collect()]
    assert [n for _, n in got] == list(range(1, 9001))
    keys = [float("-inf") if k is None else k for k, _ in got]
    assert keys == sorted(keys) and keys[0] == float("-inf")
    assert range_rank(df.limit(0), "k").count() == 0


def test_small_samples_are_cut_in_each_task(spark, monkeypatch):
    from pyspark.sql import functions as F

    from volumetry.functions.hashing import digest
    from volumetry.operators import ordering

    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("g")).repartition(6)
    for keys, step in (([], "TakeOrderedAndProject"), (["g"], "WindowGroupLimit")):
        small = ordering.hash_sample(df, digest(1, F.col("id")), ["id"], 40, keys)
        assert small._jdf.queryExecution().executedPlan().toString().count(step) >= 1
        monkeypatch.setattr(ordering, "BOTTOM", 0)
        assert sorted(small.collect()) == sorted(ordering.hash_sample(df, digest(1, F.col("id")), ["id"], 40, keys).collect())
        monkeypatch.undo()
