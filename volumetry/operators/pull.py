"""New grids from old ones by pulling: every sample of the new grid knows where it comes from.

A map of a volume takes a place ``t`` of the new grid to ``s = m ((t - c) / r) + d`` of the old one, kept
inside it (border samples repeat). Outside ``low..high`` the new grid is zero. Turns, flips, resampling,
padding and cropping are such maps and fold into one, so a chain of them reads its samples once.

The corners of a new brick bound the box of old samples that it can ask for, as a linear map takes boxes
into the hull of their corners. Old bricks send each new brick their share of its box, and a group of one
new brick puts the box together and gathers by numpy. Boxes are the only thing that is shuffled, once; a
group holds one box, whose size follows from the side of a brick and the scale of the map. Bricks of one place,
shape and map are cut, and boxes of one row are gathered, a stack at a time (``stacks``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volumetry.config import INTERPOLATIONS, check_choice
from volumetry.operators import stacks
from volumetry.schema import BRICK_SIDE, attach

CELL = ["bx", "by", "bz"]
MAP = {"shape": "array<int>", "target": "array<int>", "m": "array<double>", "c": "array<double>", "r": "array<double>",
       "d": "array<double>", "low": "array<int>", "high": "array<int>"}


def vector(*xs) -> Column:
    """An array of three numbers for the fields ``c``, ``r`` and ``d``, or of nine for ``m``, row by row."""
    return F.array(*[(x if isinstance(x, Column) else F.lit(float(x))).cast("double") for x in xs])


def with_map(volumes: DataFrame, m: Column, c: Column, r: Column, d: Column, target: Column | None = None,
             low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Headers with the fields of a map. The new grid is as large as the old one, and all of it is filled,
    unless ``target``, ``low`` and ``high`` say otherwise."""
    goal = F.col("shape") if target is None else target
    zeros = F.array(*[F.lit(0)] * 3)
    made = {"target": goal, "m": m, "c": c, "r": r, "d": d, "low": zeros if low is None else low,
            "high": F.transform(goal, lambda n: n - 1) if high is None else high}
    return volumes.withColumns({k: v.cast(MAP[k]) for k, v in made.items()})


def _numbers(row: dict) -> dict:
    return {k: np.array(row[k], "float64" if k in "mcrd" else "int64") for k in MAP} | {"m": np.array(row["m"]).reshape(3, 3)}


def _filled(p: dict, start: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of new bricks (rows of ``start``) that the map fills; empty if last < first."""
    return np.maximum(start, p["low"]), np.minimum(np.minimum(start + side, p["target"]) - 1, p["high"])


def _boxes(p: dict, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last old sample on each axis that places ``first..last`` can ask for."""
    corners = np.stack([np.where(bits, last, first) for bits in product((False, True), repeat=3)])
    places = np.clip(((corners - p["c"]) / p["r"]) @ p["m"].T + p["d"], 0, p["shape"] - 1)
    # one sample more on either side: rounding may put a place beside a corner's
    return (np.maximum(np.floor(places.min(axis=0)) - 1, 0).astype("int64"),
            np.minimum(np.floor(places.max(axis=0)) + 2, p["shape"] - 1).astype("int64"))


GEOMETRY = ["origin", "dims", *MAP]


def _first(rows: pa.RecordBatch) -> dict:
    """Place and map of a row, for all rows of its stack."""
    return {k: rows.column(k)[0].as_py() for k in GEOMETRY}


def _sender(values: list[str], side: int, schema: pa.Schema):
    def pieces(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, n = _first(rows), rows.num_rows
        p = _numbers(row)
        counts = -(-p["target"] // side)
        start = np.stack(np.meshgrid(*[np.arange(k) * side for k in counts], indexing="ij"), -1).reshape(-1, 3)
        first, last = _filled(p, start, side)
        filled = (first <= last).all(axis=1)
        low, high = _boxes(p, np.minimum(first, last), last)
        mine = np.array(row["origin"])
        a, b = np.maximum(low - mine, 0), np.minimum(high + 1 - mine, np.array(row["dims"]))
        blocks = {v: stacks.matrix(rows.column(v)).reshape(n, *row["dims"]) for v in values}
        none = np.zeros((len(start), 3), "int64")
        cuts = [(k, a, b) for k in np.flatnonzero(filled & (a < b).all(axis=1))]
        if not mine.any():  # new bricks without any source come from the first brick
            cuts += [(k, none, none) for k in np.flatnonzero(~filled)]
        for k, a, b in cuts:
            place = (slice(None), *(slice(i, j) for i, j in zip(a[k], b[k])))
            made = {"origin": stacks.lists(np.tile(mine + a[k], (n, 1)), schema.field("origin").type),
                    "dims": stacks.lists(np.tile(b[k] - a[k], (n, 1)), schema.field("dims").type)}
            made |= {v: stacks.lists(blocks[v][place].reshape(n, -1), schema.field(v).type) for v in values}
            made |= {c: pa.array(np.full(n, i), pa.int32()) for c, i in zip(CELL, start[k] // side)}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else rows.column(f.name).cast(f.type) for f in schema], schema=schema)

    def samples(row: pa.RecordBatch) -> int:
        return len(row.column(values[0]).flatten()) * len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from stacks.sent(stacks.stacked(batch, GEOMETRY, values, samples, pieces), values[0])

    return run


def gathered(box: np.ndarray, at: np.ndarray, places: np.ndarray, mode: str, flipped: np.ndarray) -> np.ndarray:
    """Values of boxes of old samples, one above the other, that start at ``at`` for places of the old grid (one a
    row). The nearest of two samples is the one farther on in the new grid."""
    every = slice(None)
    if mode == "nearest":
        k = np.where(flipped, np.ceil(places - 0.5), np.floor(places + 0.5)).astype("int64") - at
        return box[every, *k.T]
    low = np.floor(places).astype("int64")
    part = places - low
    top = at + np.array(box.shape[1:]) - 1
    out = np.zeros((len(box), len(places)))
    for bits in product((0, 1), repeat=3):
        weight = np.prod(np.where(bits, part, 1 - part), axis=1)
        k = np.minimum(low + bits, top) - at
        out += np.where(weight > 0, weight * box[every, *k.T], 0.0)  # a corner without weight may be NaN
    return out


def _gatherer(values: list[str], mode: str, side: int, schema: pa.Schema):
    def gather(rows: pa.RecordBatch, several: bool) -> pa.RecordBatch:
        """New bricks of the rows: one of all rows, or one of each in a stack of one place and map."""
        p = _numbers(_first(rows))
        n = 1 if several else rows.num_rows
        start = np.array([rows.column(c)[0].as_py() for c in CELL]) * side
        size = np.minimum(start + side, p["target"]) - start
        first, last = _filled(p, start[None], side)
        out = {v: np.zeros((n, *size)) for v in values}
        if (first <= last).all():
            low, high = _boxes(p, first, last)
            low, high, first, last = low[0], high[0], first[0], last[0]
            places = np.stack(np.meshgrid(*[np.arange(a, b + 1) for a, b in zip(first, last)], indexing="ij"), -1).reshape(-1, 3)
            places = np.clip(((places - p["c"]) / p["r"]) @ p["m"].T + p["d"], 0, p["shape"] - 1)
            inside = (slice(None), *(slice(a, b) for a, b in zip(first - start, last + 1 - start)))
            for v in values:
                box = np.full((n, *(high + 1 - low)), np.nan)
                for i in range(rows.num_rows if several else 1):
                    some = rows.slice(i, 1) if several else rows
                    dims = some.column("dims")[0].as_py()
                    place = (slice(None), *(slice(o, o + k) for o, k in zip(np.array(some.column("origin")[0].as_py()) - low, dims)))
                    if all(dims):
                        box[place] = stacks.matrix(some.column(v)).reshape(n, *dims)
                out[v][inside] = gathered(box, low, places, mode, p["m"].sum(axis=1) < 0).reshape(n, *(last + 1 - first))
        kind = {f.name: f.type for f in schema}
        made = {"origin": stacks.lists(np.tile(start, (n, 1)), kind["origin"]), "dims": stacks.lists(np.tile(size, (n, 1)), kind["dims"])}
        made |= {v: stacks.lists(out[v].reshape(n, -1), kind[v]) for v in values}
        return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else rows.column(f.name).slice(0, n).cast(f.type) for f in schema], schema=schema)

    def samples(row: pa.RecordBatch) -> int:
        return max(len(row.column(values[0]).flatten()), int(np.prod(np.minimum(row.column("target")[0].as_py(), side)))) * len(values)

    def work(one: pa.RecordBatch, more: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = stacks.lists(np.stack([one.column(c).to_numpy() for c in CELL], axis=1), pa.list_(pa.int32()))
        placed = pa.RecordBatch.from_arrays([*one.columns, cells], names=[*one.schema.names, "_cell"])
        yield from stacks.stacked(placed, [*GEOMETRY, "_cell"], values, samples, lambda r: iter([gather(r, False)]))
        yield from (gather(r, True) for r in more)

    return work


def pull(packed: DataFrame, maps: DataFrame, mode: str = "trilinear", keys: Sequence[str] = ("volume_id",),
         values: Sequence[str] = ("value",), key: str | None = None, groups: int | None = None, side: int = BRICK_SIDE) -> DataFrame:
    """Bricks ``(keys, origin, dims, values as doubles)`` of the new grids. ``maps`` has one row a volume with
    the fields of ``with_map``, joined on ``key`` (the first of ``keys``); other keys pass along. Volumes
    without a map are left out. Input bricks must start at multiples of anything and cover the grid."""
    check_choice("interpolation", mode, INTERPOLATIONS)
    keys, values, key = list(keys), list(values), key or keys[0]
    given = packed.select(*keys, "origin", "dims", *[F.col(v).cast("array<double>").alias(v) for v in values])
    home = attach(given, maps.select(key, *MAP), [key], groups, "inner")
    kinds = T.StructType([*home.schema.fields, *[T.StructField(c, T.IntegerType()) for c in CELL]])
    sent = home.mapInArrow(_sender(values, side, arrow_schema(kinds)), kinds)
    made = T.StructType([*(given.schema[k] for k in keys), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("origin", "dims")),
                         *(T.StructField(v, T.ArrayType(T.DoubleType())) for v in values)])
    kind = arrow_schema(made)
    return stacks.in_groups(sent, [*keys, *CELL], maps, "target", made, _gatherer(values, mode, side, kind), kind)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    plain = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.FloatType: pa.float32(),
             T.ShortType: pa.int16(), T.ByteType: pa.int8(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}

    def kind(t: T.DataType) -> pa.DataType:
        return pa.list_(kind(t.elementType)) if isinstance(t, T.ArrayType) else plain[type(t)]

    return pa.schema([(f.name, kind(f.dataType)) for f in schema])
