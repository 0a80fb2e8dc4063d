"""Small volumes as tables and back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

PACKED = "volume_id long, origin array<int>, dims array<int>, value array<double>"


def packed(spark, cubes: dict[int, np.ndarray]):
    rows = [(i, [0, 0, 0], list(c.shape), [float(v) for v in c.reshape(-1)]) for i, c in cubes.items()]
    return spark.createDataFrame(rows, PACKED)


def heads(spark, cubes: dict[int, np.ndarray], spacing=(1.0, 1.0, 1.0)):
    rows = [(i, list(c.shape), list(spacing)) for i, c in cubes.items()]
    return spark.createDataFrame(rows, "volume_id long, shape array<int>, spacing array<double>")


def cubes_of(df, value: str = "value", key: str = "volume_id") -> dict[int, np.ndarray]:
    pdf = df.select(key, "x", "y", "z", F.col(value).cast("double").alias("v")).toPandas()
    out = {}
    for i, part in pdf.groupby(key):
        cube = np.full(tuple(part[c].max() + 1 for c in "xyz"), np.nan)
        assert not part.duplicated(["x", "y", "z"]).any()
        cube[part["x"], part["y"], part["z"]] = part["v"]
        out[i] = cube
    return out


def random_cubes(n: int = 3, shape=(7, 6, 5), seed: int = 0) -> dict[int, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {i: np.maximum(rng.normal(100, 60, shape), 0.0) for i in range(n)}


def mask_rows(df) -> dict[int, set]:
    out: dict[int, set] = {}
    for r in df.select("volume_id", "x", "y", "z").collect():
        out.setdefault(r[0], set()).add((r[1], r[2], r[3]))
    return out
