"""Overlapping tiles and random patches by arithmetic on coordinates and equality joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volumetry.functions.hashing import whole_between
from volumetry.operators.pull import arrow_schema
from volumetry.operators.stencil import part_of, scatter
from volumetry.schema import BRICK_SIDE, attach, voxels

AXES = ("x", "y", "z")
TILE = ["x0", "y0", "z0"]


def strides(size: Sequence[int], overlap: float) -> list[int]:
    out = [int(p * (1 - overlap)) for p in size]
    if min(out) < 1:
        raise ValueError(f"overlap {overlap} leaves no stride for tiles of {tuple(size)}")
    return out


def _last(n: Column, p: int, stride: int) -> Column:
    """Number of the last tile on an axis; negative when the tile does not fit."""
    return F.floor((n - p) / F.lit(float(stride))).cast("int")


def tile_grid(volumes: DataFrame, size: Sequence[int], overlap: float = 0.5) -> DataFrame:
    """Tile starts of every volume; no tail tile, and none where the volume is smaller than a tile."""
    out = volumes.select("volume_id", "shape")
    for i, (name, p, s) in enumerate(zip(TILE, size, strides(size, overlap))):
        n = F.col("shape")[i]
        starts = F.when(n >= p, F.sequence(F.lit(0), n - p, F.lit(s))).otherwise(F.array().cast("array<int>"))
        out = out.withColumn(name, F.explode(starts))
    return out.drop("shape")


def _covering(i: int, size: Sequence[int], step: Sequence[int]) -> tuple[Column, Column]:
    """First and last number of the tiles over a coordinate."""
    c, p, s = F.col(AXES[i]), size[i], step[i]
    first = F.greatest(F.ceil((c - p + 1) / F.lit(float(s))).cast("int"), F.lit(0))
    last = F.least(F.floor(c / F.lit(float(s))).cast("int"), _last(F.col("shape")[i], p, s))
    return first, last


def tile_members(df: DataFrame, volumes: DataFrame, size: Sequence[int], overlap: float = 0.5, value: str = "value",
                 groups: int | None = None) -> DataFrame:
    """Each sample once per tile over it: starts come from its coordinates, without a range join."""
    step = strides(size, overlap)
    out = voxels(attach(df, volumes.select("volume_id", "shape"), ["volume_id"], groups, "inner"), value)
    for i, name in enumerate(TILE):
        first, last = _covering(i, size, step)
        numbers = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        stride = F.lit(step[i])
        out = out.withColumn(name, F.explode(F.transform(numbers, lambda k: k * stride)))
    return out.drop("shape")


def tiled_apply(df: DataFrame, volumes: DataFrame, fn: Callable[[DataFrame, list[str]], DataFrame], size: Sequence[int],
                overlap: float = 0.5, value: str = "value", groups: int | None = None) -> DataFrame:
    """Applies ``fn(rows, tile_keys)`` to all tiles and averages overlaps; samples outside every
    tile keep their input. Input and tile results meet in one aggregation, not in a join."""
    keys = ["volume_id", *TILE]
    done = fn(tile_members(df, volumes, size, overlap, value, groups), keys)
    tiled = done.select("volume_id", *AXES, F.col(value).cast("double").alias("_t"), F.lit(None).cast("double").alias("_i"))
    plain = voxels(df, value).select("volume_id", *AXES, F.lit(None).cast("double").alias("_t"),
                                     F.col(value).cast("double").alias("_i"))
    return tiled.unionByName(plain).groupBy("volume_id", *AXES).agg(
        F.coalesce(F.avg("_t"), F.max("_i")).alias(value))


PIECE = "volume_id long, {} int, {} int, {} int, origin array<int>, dims array<int>, value array<double>"
PIECE_ARROW = [("origin", pa.list_(pa.int32())), ("dims", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))]


def tiled_model(packed: DataFrame, volumes: DataFrame, model: Callable[[np.ndarray], np.ndarray], size: Sequence[int],
                overlap: float = 0.5, groups: int | None = None, side: int = BRICK_SIDE) -> DataFrame:
    """Applies a model to dense tiles and averages overlaps, brick by brick; returns bricks.

    Bricks send each tile the box they share with it, a group of one tile runs the model and sends
    its result back to the bricks below it, a group of one brick averages. Arrays travel, never
    single samples, and no group is larger than a tile or a brick with its tiles. A model that is
    loaded at import or kept in a module lives once per Python worker.
    """
    size, step = tuple(size), strides(size, overlap)
    home = attach(packed.select("volume_id", "origin", "dims", F.col("value").cast("array<double>").alias("value")),
                  volumes.select("volume_id", "shape"), ["volume_id"], groups, "inner")
    to_tiles = home.mapInArrow(_to_tiles(home.columns, size, step), PIECE.format(*TILE))
    made = to_tiles.groupBy("volume_id", *TILE).applyInArrow(_run_tile(model, size, side), PIECE.format("bx", "by", "bz"))
    at = lambda i: F.floor(F.col("origin")[i] / side).cast("int")
    inputs = home.select("volume_id", at(0).alias("bx"), at(1).alias("by"), at(2).alias("bz"), "origin", "dims", "value",
                         F.lit(True).alias("input"))
    every = inputs.unionByName(made.withColumn("input", F.lit(False)))
    return every.groupBy("volume_id", "bx", "by", "bz").applyInArrow(
        _average, "volume_id long, origin array<int>, dims array<int>, value array<double>")


def _to_tiles(columns: list[str], size: tuple[int, ...], step: list[int]):
    def pieces(row: dict) -> Iterator[dict]:
        spans = []
        for o, n, total, p, s in zip(row["origin"], row["dims"], row["shape"], size, step):
            first, last = max(0, -((p - 1 - o) // s)), min((o + n - 1) // s, (total - p) // s if total >= p else -1)
            spans.append([k * s for k in range(first, last + 1)])
        for start in product(*spans):
            cut = [(max(t - o, 0), min(t + p - o, n)) for t, p, o, n in zip(start, size, row["origin"], row["dims"])]
            part = part_of(row, cut, ["value"])
            yield {"volume_id": row["volume_id"], **dict(zip(TILE, start)), **{c: part[c] for c in ("origin", "dims", "value")}}

    kind = pa.schema([("volume_id", pa.int64()), *[(t, pa.int32()) for t in TILE], *PIECE_ARROW])
    return scatter(columns, ["value"], pieces, kind)


def _run_tile(model: Callable[[np.ndarray], np.ndarray], size: tuple[int, ...], side: int):
    def run(rows: pa.Table) -> pa.Table:
        start = [rows.column(t)[0].as_py() for t in TILE]
        cube = np.zeros(size)
        for i in range(rows.num_rows):
            origin, dims = rows.column("origin")[i].as_py(), rows.column("dims")[i].as_py()
            place = tuple(slice(o - s, o - s + n) for o, s, n in zip(origin, start, dims))
            cube[place] = rows.column("value")[i].values.to_numpy().reshape(dims)
        whole = {"origin": start, "dims": list(size), "value": np.asarray(model(cube), dtype="float64").reshape(-1)}
        spans = [range(s // side, (s + p - 1) // side + 1) for s, p in zip(start, size)]
        out = []
        for brick in product(*spans):
            cut = [(max(b * side - s, 0), min((b + 1) * side - s, p)) for b, s, p in zip(brick, start, size)]
            out.append(part_of(whole, cut, ["value"]) | {"volume_id": rows.column("volume_id")[0].as_py()}
                       | dict(zip(("bx", "by", "bz"), brick)))
        return pa.Table.from_pylist(out, schema=pa.schema(
            [("volume_id", pa.int64()), *[(b, pa.int32()) for b in ("bx", "by", "bz")], *PIECE_ARROW]))

    return run


def _average(rows: pa.Table) -> pa.Table:
    home = int(np.flatnonzero(rows.column("input").to_numpy())[0])
    start, dims = rows.column("origin")[home].as_py(), rows.column("dims")[home].as_py()
    total, count = np.zeros(dims), np.zeros(dims)
    for i in range(rows.num_rows):
        if i != home:
            origin, size = rows.column("origin")[i].as_py(), rows.column("dims")[i].as_py()
            place = tuple(slice(o - s, o - s + n) for o, s, n in zip(origin, start, size))
            total[place] += rows.column("value")[i].values.to_numpy().reshape(size)
            count[place] += 1
    given = rows.column("value")[home].values.to_numpy().reshape(dims)
    out = np.where(count > 0, total / np.maximum(count, 1), given)
    return pa.table({"volume_id": rows.column("volume_id").slice(home, 1), "origin": rows.column("origin").slice(home, 1),
                     "dims": rows.column("dims").slice(home, 1), "value": pa.array([out.reshape(-1)], pa.list_(pa.float64()))})


def identity(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows


def demean(value: str = "value"):
    """Subtracts the mean of the tile; the window holds one tile."""
    def apply(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.withColumn(value, F.col(value) - F.avg(F.col(value).cast("double")).over(Window.partitionBy(*keys)))

    return apply


def tile_coverage(df: DataFrame, volumes: DataFrame, size: Sequence[int], overlap: float = 0.5, value: str = "value",
                  groups: int | None = None) -> DataFrame:
    """Tiles of each volume and how its samples are covered, counted without building any tile."""
    step = strides(size, overlap)
    rows = voxels(attach(df, volumes.select("volume_id", "shape"), ["volume_id"], groups, "inner"), value)
    cover, tiles = F.lit(1), F.lit(1)
    for i in range(3):
        first, last = _covering(i, size, step)
        cover = cover * F.greatest(last - first + 1, F.lit(0))
        tiles = tiles * F.greatest(_last(F.col("shape")[i], size[i], step[i]) + 1, F.lit(0))
    return rows.groupBy("volume_id").agg(
        F.max(tiles).alias("n_tiles"), F.count(F.when(cover == 0, 1)).alias("n_uncovered"),
        F.max(cover).alias("max_cover"), F.sum(cover).alias("n_memberships"))


def patch_origins(pairs: DataFrame, size: Sequence[int], k: int, seed: int = 42, pad: bool = False,
                  key: str = "pair_id") -> DataFrame:
    """``k`` seeded starts per pair, uniform over every place where the patch fits. A patch larger
    than the volume fails the job, or starts at 0 and is filled with zeros when ``pad`` is set."""
    out = pairs.withColumn("patch", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    for i, name in enumerate(TILE):
        room = F.col("shape")[i] - size[i]
        draw = whole_between(0, F.greatest(room, F.lit(0)), seed, F.col(key), F.col("patch"), AXES[i])
        small = F.lit(0) if pad else F.raise_error(F.concat(
            F.lit("patch does not fit into pair "), F.col(key).cast("string"))).cast("int")
        out = out.withColumn(name, F.when(room < 0, small).otherwise(draw))
    return out


def extract_patches(origins: DataFrame, rows: DataFrame, size: Sequence[int], values: Sequence[str] = ("a", "b"),
                    key: str = "pair_id", pad: bool = False) -> DataFrame:
    """Patch samples with coordinates inside the patch. A patch asks for its lines (x, y); the join
    is an equality on pair and line, so patches never meet samples far from them."""
    span = lambda p: F.sequence(F.lit(0), F.lit(p - 1))
    lines = origins.select(key, "patch", *TILE, F.explode(span(size[0])).alias("dx")).withColumn(
        "dy", F.explode(span(size[1])))
    if pad:
        asked = lines.withColumn("dz", F.explode(span(size[2]))).withColumns(
            {c: F.col(f"{c}0") + F.col(f"d{c}") for c in AXES})
        found = asked.join(rows, [key, *AXES], "left")
        return found.select(key, "patch", "dx", "dy", "dz", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])
    asked = lines.withColumns({c: F.col(f"{c}0") + F.col(f"d{c}") for c in ("x", "y")})
    near = asked.join(rows, [key, "x", "y"]).where(
        (F.col("z") >= F.col("z0")) & (F.col("z") < F.col("z0") + size[2]))
    return near.select(key, "patch", "dx", "dy", (F.col("z") - F.col("z0")).alias("dz"), *values)


def routed_patches(origins: DataFrame, packed: DataFrame, size: Sequence[int], values: Sequence[str] = ("a", "b"), key: str = "pair_id",
                   side: int = BRICK_SIDE) -> DataFrame:
    """Patches ``(key, patch, x0, y0, z0, values)`` cut from bricks that start at multiples of ``side``: each
    patch asks the bricks under it, those send the box they share with it, and a group of one patch puts the
    boxes together. Samples outside the grid, if the patch begins where it does not fit, are 0."""
    values, size = list(values), tuple(size)
    cells = ["bx", "by", "bz"]
    asked = origins.select(key, "patch", *TILE)
    for name, t, p in zip(cells, TILE, size):
        first, last = F.floor(F.col(t) / side).cast("int"), F.floor((F.col(t) + p - 1) / side).cast("int")
        asked = asked.withColumn(name, F.explode(F.sequence(first, last)))
    at = [F.floor(F.col("origin")[i] / side).cast("int").alias(c) for i, c in enumerate(cells)]
    # a brick gets the requests of one cell as one list, so it is unpacked once
    asked = asked.groupBy(key, *cells).agg(F.collect_list(F.struct("patch", *TILE)).alias("asked"))
    held = packed.select(key, "origin", "dims", *[F.col(v).cast("array<double>").alias(v) for v in values], *at).join(asked, [key, *cells])
    given = T.StructType([held.schema[key], T.StructField("patch", T.IntegerType()), *(T.StructField(t, T.IntegerType()) for t in TILE),
                          *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("origin", "dims")),
                          *(T.StructField(v, T.ArrayType(T.DoubleType())) for v in values)])

    def pieces(row: dict) -> Iterator[dict]:
        for want in row["asked"]:
            cut = [(max(want[t] - o, 0), min(want[t] + p - o, n)) for t, p, o, n in zip(TILE, size, row["origin"], row["dims"])]
            if all(a < b for a, b in cut):
                part = part_of(row, cut, values)
                yield {key: row[key], "patch": want["patch"], **{t: want[t] for t in TILE}, **{c: part[c] for c in ("origin", "dims", *values)}}

    made = T.StructType([given[key], given["patch"], *(given[t] for t in TILE), *(given[v] for v in values)])

    def whole(rows: pa.Table) -> pa.Table:
        start = [rows.column(t)[0].as_py() for t in TILE]
        out = {v: np.zeros(size) for v in values}
        for i in range(rows.num_rows):
            dims = rows.column("dims")[i].as_py()
            place = tuple(slice(o - s, o - s + n) for o, s, n in zip(rows.column("origin")[i].as_py(), start, dims))
            for v in values:
                out[v][place] = rows.column(v)[i].values.to_numpy().reshape(dims)
        first = rows.slice(0, 1).select([key, "patch", *TILE])
        return pa.table([*first.columns, *(pa.array([a.reshape(-1)], pa.list_(pa.float64())) for a in out.values())], schema=arrow_schema(made))

    cut = scatter([key, "origin", "dims", "asked", *values], values, pieces, arrow_schema(given))
    return held.select(key, "origin", "dims", "asked", *values).mapInArrow(cut, given).groupBy(key, "patch").applyInArrow(whole, made)


def pack_patches(patches: DataFrame, values: Sequence[str] = ("a", "b"), key: str = "pair_id") -> DataFrame:
    """One row per patch with C-order arrays; a group is one patch."""
    cells = F.array_sort(F.collect_list(F.struct("dx", "dy", "dz", *values)))
    packed = patches.groupBy(key, "patch").agg(cells.alias("_c"))
    return packed.select(key, "patch", *[F.col(f"_c.{v}").alias(v) for v in values])
