"""Many small volumes: worked on in stacks of one shape, in groups that hold many of them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from volumetry.operators import bitmasks, grid, stacks

SHAPES = [(3, 2, 4), (2, 2, 2), (3, 2, 4), (1, 3, 1)]


def cohort(spark, n=60):
    r = np.random.default_rng(5)
    cubes = {(None if v == 7 else v): r.normal(size=SHAPES[v % 4]) for v in range(n)}
    rows = [(v, [0, 0, 0], list(c.shape), c.reshape(-1).tolist()) for v, c in cubes.items()]
    packed = spark.createDataFrame(rows, "volume_id long, origin array<int>, dims array<int>, value array<double>")
    heads = packed.select("volume_id", F.col("dims").alias("shape"), F.lit("LPS").alias("orientation"))
    return {v: c for v, c in cubes.items() if v is not None}, packed, heads


def test_small_volumes_share_groups(spark):
    cubes, packed, heads = cohort(spark)
    bits = bitmasks.above(packed, F.lit(0.0))
    turned = grid.fitted(packed, heads, "RAS", size=(4, 4, 4), groups=60)[0]
    grown = bitmasks.morph(bits, heads, [("dilate", 1)], groups=60)
    for made in (turned, grown):  # the map's groups are buckets, not volumes
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        line = next(x for x in plan.split("\n") if "FlatMapGroupsInArrow" in x)
        assert "_bucket" in line.split("]")[0] and "volume_id" not in line.split("]")[0]
    goal = {v: np.zeros((4, 4, 4)) for v in cubes}
    for v, c in cubes.items():
        c = c[::-1, ::-1]
        pad = [(4 - n) // 2 for n in c.shape]
        goal[v][tuple(slice(p, p + n) for p, n in zip(pad, c.shape))] = c
    found = {r.volume_id: np.array(r.value).reshape(r.dims) for r in turned.collect()}
    assert set(found) == set(goal) and all((found[v] == goal[v]).all() for v in goal)
    got = {r.volume_id: bitmasks._unpack(r.bits, r.dims) for r in grown.collect()}
    for v, c in cubes.items():
        want = np.pad(c > 0, 1)
        want = sum(np.roll(want, s, a) for a in range(3) for s in (-1, 1)) + want > 0
        assert (got[v] == want[1:-1, 1:-1, 1:-1]).all()


def test_parts_of_a_stack(spark):
    cubes, packed, heads = cohort(spark)
    bits = bitmasks.above(packed, F.lit(0.0))
    found = {}
    for r in bitmasks.components(bits, heads).collect():
        found.setdefault(r.volume_id, []).append((r.label, r.n))
    for v, c in cubes.items():
        named = bitmasks.labels(c > 0, (0, 0, 0))
        assert sorted(found.get(v, [])) == [(int(k), int((named == k).sum())) for k in np.unique(named[c > 0])]


def test_one_call_a_shape():
    calls = []
    batch = pa.record_batch({"dims": pa.array([list(SHAPES[i % 4]) for i in range(400)]), "at": pa.array(range(400))})

    def work(rows):
        calls.append(rows.num_rows)
        yield rows

    made = list(stacks.sent(stacks.stacked(batch, ["dims"], [], lambda r: 8, work)))
    assert sorted(calls) == [100, 100, 200]
    assert sorted(x for b in made for x in b.column("at").to_pylist()) == list(range(400))
    uneven = pa.record_batch({"dims": pa.array([[1, 2], None, [1], [1, 2], None])})
    assert sorted(map(list, stacks.places(uneven, ["dims"]))) == [[0, 3], [1, 4], [2]]


def test_null_and_nan_are_keys():
    keys = pa.record_batch({"k": pa.array([1.0, 1.0, float("nan"), float("nan"), None, None])})
    assert stacks._starts(keys, ["k"]).tolist() == [0, 2, 4]
    one, more = stacks.alone(keys.slice(1, 3), np.array([0, 1]))
    assert one.column("k").to_pylist() == [1.0] and [r.num_rows for r in more] == [2]
