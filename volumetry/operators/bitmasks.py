"""Masks as bit-packed bricks: ``(keys, origin, dims, bits)``, eight voxels a byte in C order.

Erosion and dilation take one exchange for a whole list of steps: each brick gets the bits of its neighbours
as far as the steps reach, and shifts, ands and ors work on the padded block. Components are labelled inside
a brick by numpy; label planes of facing sides alone meet across bricks, and their pairs are contracted as a
small graph. Neighbours are the six across faces, and everything outside the grid counts as empty.

A label is the place of a component's first voxel in grid order. Nothing here makes a row of a voxel but
``set_voxels``. Bricks start at multiples of ``side`` and cover their grid.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volumetry.operators import stacks
from volumetry.operators.masks import ORDER_BITS, _stars
from volumetry.operators.ordering import percentiles
from volumetry.operators.pull import arrow_schema
from volumetry.schema import BRICK_SIDE, attach, finite, positive
from volumetry.session import cut_lineage

CELL = ["bx", "by", "bz"]
STEPS = {"erode", "dilate"}


def _unpack(data: bytes, dims: Sequence[int]) -> np.ndarray:
    n = int(np.prod(dims))
    return np.unpackbits(np.frombuffer(data, "u1"), count=n).reshape(dims).astype(bool)


def _pack(mask: np.ndarray) -> bytes:
    return np.packbits(mask.reshape(-1)).tobytes()


def _cells(side: int) -> list[Column]:
    return [F.floor(F.col("origin")[i] / side).cast("int").alias(c) for i, c in enumerate(CELL)]


def _fields(df: DataFrame, keys: Sequence[str], *more: T.StructField) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("origin", "dims")), *more])


BITS = T.StructField("bits", T.BinaryType())


def _unpacked(data: pa.Array, dims: Sequence[int]) -> np.ndarray:
    """Masks of bricks of equal dims and bytes, one above the other."""
    raw = np.frombuffer(b"".join(data.to_pylist()), "u1").reshape(len(data), -1)
    return np.unpackbits(raw, axis=1, count=int(np.prod(dims))).reshape(len(data), *dims).astype(bool)


def _packed(masks: np.ndarray) -> pa.Array:
    raw = np.packbits(masks.reshape(len(masks), -1), axis=1)
    return pa.array([r.tobytes() for r in raw], pa.binary())


def _mapped(batches: Iterator[pa.RecordBatch], keep: list[str], schema: pa.Schema, fn) -> Iterator[pa.RecordBatch]:
    """Batches with the kept columns and, behind them, what ``fn(row)`` gives for each row."""
    for batch in batches:
        made = [fn(r) for r in batch.to_pylist()]
        new = [pa.array([m[k] for m in made], f.type) for k, f in enumerate(list(schema)[len(keep):])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(schema.field(c).type) for c in keep), *new], schema=schema)


def _stacked(batches: Iterator[pa.RecordBatch], keep: list[str], schema: pa.Schema, same: list[str], sized: list[str], fn) -> Iterator[pa.RecordBatch]:
    """Batches with the kept columns and, behind them, what ``fn(rows)`` gives for rows that agree in ``same`` and in the lengths of ``sized``."""
    def run(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        new = [a.cast(f.type) for a, f in zip(fn(rows), list(schema)[len(keep):])]
        yield pa.RecordBatch.from_arrays([*(rows.column(c).cast(schema.field(c).type) for c in keep), *new], schema=schema)

    def samples(row: pa.RecordBatch) -> int:
        if "value" in row.schema.names:
            return len(row.column("value").flatten())
        return int(np.prod(row.column("dims")[0].as_py()))

    for batch in batches:
        yield from stacks.sent(stacks.stacked(batch, same, sized, samples, run), "value" if "value" in schema.names else None)


def above(packed: DataFrame, cut: Column, keys: Sequence[str] = ("volume_id",), value: str = "value") -> DataFrame:
    """Bits of the samples above ``cut``, a column of the rows; none where it is null, and NaN is not above."""
    keys = list(keys)
    given = packed.select(*keys, "origin", "dims", F.col(value).cast("array<double>").alias("value"), cut.cast("double").alias("cut"))
    schema = _fields(given, keys, BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bits(rows: pa.RecordBatch) -> tuple[pa.Array]:
            limit = rows.column("cut").fill_null(np.inf).to_numpy()
            return (_packed(stacks.matrix(rows.column("value")) > limit[:, None]),)

        return _stacked(batches, [*keys, "origin", "dims"], arrow_schema(schema), [], ["value"], bits)

    return given.mapInArrow(run, schema)


def threshold(packed: DataFrame, p: float = 10.0, keys: Sequence[str] = ("volume_id",), value: str = "value", groups: int | None = None) -> DataFrame:
    """Bits of the samples above the p-th percentile of the positive ones; nothing in an empty volume."""
    cut = percentiles(packed, keys, value, [p], lambda v: positive(v) & finite(v), groups).select(*keys, F.col("pct")[0].alias("_cut"))
    return above(attach(packed, cut, list(keys), groups), F.col("_cut"), keys, value)


def morph(bits: DataFrame, volumes: DataFrame, steps: Sequence[tuple[str, int]], keys: Sequence[str] = ("volume_id",), groups: int | None = None,
          side: int = BRICK_SIDE) -> DataFrame:
    """Applies ``("erode", n)`` and ``("dilate", n)`` in order, with one exchange of faces."""
    keys, steps = list(keys), list(steps)
    if any(s not in STEPS or n < 0 for s, n in steps):
        raise ValueError(f"steps are pairs of one of {sorted(STEPS)} and a number, not {steps}")
    reach = sum(n for _, n in steps)
    if reach > side:
        raise ValueError(f"steps reach {reach} voxels, beyond bricks of side {side}")
    home = attach(bits.select(*keys, "origin", "dims", "bits"), volumes.select(*keys, "shape"), keys, groups, "inner")
    home = home.select(*keys, "origin", "dims", "bits", "shape", *_cells(side), F.lit(True).alias("center"))
    kinds = _fields(home, keys, BITS, T.StructField("shape", T.ArrayType(T.IntegerType())), *(T.StructField(c, T.IntegerType()) for c in CELL),
                    T.StructField("center", T.BooleanType()))

    def faces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = arrow_schema(kinds)
        for batch in batches:
            ends = [(stacks.matrix(batch.column(c)) if batch.num_rows else np.zeros((0, 3))) for c in ("origin", "dims", "shape")]
            inner = ((ends[0] != 0) | (ends[0] + ends[1] < ends[2])).any(axis=1)
            if not inner.all():  # bricks that are whole volumes have no neighbours
                whole = batch.filter(pa.array(~inner))
                yield pa.RecordBatch.from_arrays([whole.column(f.name).cast(f.type) for f in kind], schema=kind)
            out = []
            for row in batch.filter(pa.array(inner)).to_pylist():
                out.append(row)
                mask = None
                for off in product((-1, 0, 1), repeat=3):
                    if not any(off) or any((o < 0 and s == 0) or (o > 0 and s + n >= t) for o, s, n, t in zip(off, row["origin"], row["dims"], row["shape"])):
                        continue
                    mask = _unpack(row["bits"], row["dims"]) if mask is None else mask
                    cut = [(0, n) if o == 0 else (max(n - reach, 0), n) if o > 0 else (0, min(reach, n)) for o, n in zip(off, row["dims"])]
                    part = mask[tuple(slice(*c) for c in cut)]
                    if part.any():  # empty sides say nothing
                        out.append({**row, "origin": [s + c[0] for s, c in zip(row["origin"], cut)], "dims": list(part.shape), "bits": _pack(part),
                                    "center": False, **{b: row[b] + o for b, o in zip(CELL, off)}})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    made = _fields(home, keys, BITS)
    kind = arrow_schema(made)

    def stepped(block: np.ndarray, start: np.ndarray, dims: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Blocks of one place, one above the other, after all steps and without their padding."""
        grid = np.zeros(block.shape[1:], bool)
        grid[tuple(slice(max(0, reach - s), min(reach - s + t, n)) for s, t, n in zip(start, shape, grid.shape))] = True
        for step, n in steps:
            for _ in range(n):
                new = block.copy()
                for axis in range(1, 4):
                    for way in (1, -1):
                        moved = np.zeros_like(block)
                        to, by = [slice(None)] * 4, [slice(None)] * 4
                        to[axis], by[axis] = (slice(1, None), slice(None, -1))[::way]
                        moved[tuple(to)] = block[tuple(by)]
                        new = new & moved if step == "erode" else new | moved
                block = new & grid
        return block[(slice(None), *(slice(reach, reach + n) for n in dims))]

    def several(rows: pa.RecordBatch) -> pa.RecordBatch:
        held = rows.to_pylist()
        mine = next(r for r in held if r["center"])
        start, dims = np.array(mine["origin"]), np.array(mine["dims"])
        block = np.zeros(dims + 2 * reach, bool)
        for r in held:
            place = tuple(slice(a, a + n) for a, n in zip(np.array(r["origin"]) - start + reach, r["dims"]))
            block[place] = _unpack(r["bits"], r["dims"])
        inner = stepped(block[None], start, dims, mine["shape"])
        return pa.RecordBatch.from_pylist([{**{k: mine[k] for k in keys}, "origin": mine["origin"], "dims": mine["dims"], "bits": _pack(inner)}], schema=kind)

    def single(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        start, dims, shape = (np.array(rows.column(c)[0].as_py()) for c in ("origin", "dims", "shape"))
        block = np.pad(_unpacked(rows.column("bits"), dims), [(0, 0), *[(reach, reach)] * 3])
        yield pa.RecordBatch.from_arrays([*(rows.column(f.name).cast(f.type) for f in list(kind)[:-1]), _packed(stepped(block, start, dims, shape))], schema=kind)

    def padded(row: pa.RecordBatch) -> int:
        return int(np.prod(np.array(row.column("dims")[0].as_py()) + 2 * reach))

    def work(one: pa.RecordBatch, more: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from stacks.stacked(one, ["origin", "dims", "shape"], ["bits"], padded, single)
        yield from (several(r) for r in more)

    return stacks.in_groups(home.mapInArrow(faces, kinds), [*keys, *CELL], volumes, "shape", made, work, kind)


def orders(dims: Sequence[int], origin: Sequence[int]) -> np.ndarray:
    """Grid place of each voxel of a brick, in C order."""
    x, y, z = (c.reshape(-1).astype("int64") + o for c, o in zip(np.indices(dims), origin))
    return (x << 2 * ORDER_BITS) + (y << ORDER_BITS) + z


def roots(masks: np.ndarray) -> np.ndarray:
    """For each voxel of a stack of masks the place in the stack of its component's first voxel, -1 where not set."""
    place = np.flatnonzero(masks.reshape(-1))
    number = np.full(masks.size, -1)
    number[place] = np.arange(len(place))
    number = number.reshape(masks.shape)
    ends = []
    for axis in range(1, 4):
        to, by = [slice(None)] * 4, [slice(None)] * 4
        to[axis], by[axis] = slice(None, -1), slice(1, None)
        a, b = number[tuple(to)].reshape(-1), number[tuple(by)].reshape(-1)
        both = (a >= 0) & (b >= 0)
        ends.append(np.stack([a[both], b[both]]))
    u, v = np.concatenate(ends, axis=1)
    parent = np.arange(len(place))
    while len(u):
        low = np.minimum(parent[u], parent[v])
        np.minimum.at(parent, parent[u], low)
        np.minimum.at(parent, parent[v], low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        apart = parent[u] != parent[v]
        u, v = u[apart], v[apart]
    out = np.full(masks.size, -1, "int64")
    out[place] = place[parent]
    return out


def labels(mask: np.ndarray, origin: Sequence[int]) -> np.ndarray:
    """For each voxel of a brick the grid place of its component's first voxel there, -1 where not set."""
    found = roots(mask[None])
    return np.where(found >= 0, orders(mask.shape, origin)[found], -1).reshape(mask.shape)


def components(bits: DataFrame, volumes: DataFrame, keys: Sequence[str] = ("volume_id",), empty: bool = False, groups: int | None = None,
               side: int = BRICK_SIDE) -> DataFrame:
    """Parts ``(keys, origin, part, n, border, label)``: the components inside each brick with their voxels,
    whether they touch the border of the grid, and the label of the whole. ``empty`` takes the voxels that
    are not set instead."""
    keys = list(keys)
    home = attach(bits.select(*keys, "origin", "dims", "bits"), volumes.select(*keys, "shape"), keys, groups, "inner")
    plane = T.ArrayType(T.LongType())
    part = T.ArrayType(T.StructType([T.StructField("part", T.LongType()), T.StructField("n", T.LongType()), T.StructField("border", T.BooleanType())]))
    schema = _fields(home, keys, T.StructField("low", T.ArrayType(plane)), T.StructField("high", T.ArrayType(plane)))
    kind = arrow_schema(schema)
    struct = pa.list_(pa.struct([("part", pa.int64()), ("n", pa.int64()), ("border", pa.bool_())]))
    kind = kind.append(pa.field("parts", struct))
    schema = T.StructType([*schema.fields, T.StructField("parts", part)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def label(rows: pa.RecordBatch) -> tuple:
            origin, dims, shape = (rows.column(c)[0].as_py() for c in ("origin", "dims", "shape"))
            n, size = rows.num_rows, int(np.prod(dims))
            found, order = roots(_unpacked(rows.column("bits"), dims) != empty), orders(dims, origin)
            named = np.where(found >= 0, order[found % size], -1).reshape(n, *dims)
            parts, counts = np.unique(found[found >= 0], return_counts=True)
            edge, faces, found = np.zeros(n * size, bool), [], found.reshape(n, *dims)
            for axis in range(3):
                ends = origin[axis] + dims[axis] >= shape[axis]
                for at, outside in ((0, origin[axis] == 0), (-1, ends)):
                    if outside:
                        face = found.take(at, axis + 1).reshape(-1)
                        edge[face[face >= 0]] = True
                faces.append([None if outside else named.take(at, axis + 1).reshape(n, -1) for at, outside in ((0, not origin[axis]), (-1, ends))])
            sides = []
            for way in range(2):
                planes = [np.zeros((n, 0), "int64") if f[way] is None else f[way] for f in faces]
                at = np.cumsum([0, *([p.shape[1] for p in planes] * n)])
                inner = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.hstack(planes).reshape(-1), pa.int64()))
                sides.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 3, pa.int32()), inner))
            each = pa.StructArray.from_arrays([pa.array(order[parts % size], pa.int64()), pa.array(counts, pa.int64()), pa.array(edge[parts])], ["part", "n", "border"])
            cuts = np.searchsorted(parts // size, np.arange(n + 1))
            return *sides, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), each)

        return _stacked(batches, [*keys, "origin", "dims"], kind, ["origin", "dims", "shape"], ["bits"], label)

    made = cut_lineage(home.mapInArrow(run, schema), "labels")
    cell = _cells(side)
    one = lambda a, name: F.struct(F.lit(a).alias("axis"), F.col(name)[a].alias("plane"))
    low = made.select(*keys, *cell, F.explode(F.array(*[one(a, "low") for a in range(3)])).alias("_p")).where(F.size("_p.plane") > 0)
    low = low.select(*keys, *CELL, F.col("_p.axis").alias("axis"), F.col("_p.plane").alias("ahead"))
    high = made.select(*keys, *cell, F.explode(F.array(*[one(a, "high") for a in range(3)])).alias("_p")).where(F.size("_p.plane") > 0)
    high = high.select(*keys, *[(F.col(c) + (F.col("_p.axis") == a).cast("int")).alias(c) for a, c in enumerate(CELL)],
                       F.col("_p.axis").alias("axis"), F.col("_p.plane").alias("behind"))
    met = high.join(low, [*keys, *CELL, "axis"])
    pairs = F.array_distinct(F.zip_with("behind", "ahead", lambda a, b: F.when((a >= 0) & (b >= 0), F.struct(a.alias("v"), b.alias("u")))))
    edges = met.select(*keys, F.explode(F.array_compact(pairs)).alias("_e")).select(*keys, "_e.u", "_e.v")
    tops = _stars(edges, keys).select(*keys, F.col("u").alias("part"), F.col("v").alias("_top"))
    parts = made.select(*keys, "origin", F.inline("parts"))
    return parts.join(tops, [*keys, "part"], "left").select(*keys, "origin", "part", "n", "border", F.coalesce("_top", "part").alias("label"))


def _chosen(bits: DataFrame, parts: DataFrame, keys: list[str], empty: bool) -> DataFrame:
    """Bits of the given parts only, or, of parts that are not set, the bits and these parts."""
    held = parts.groupBy(*keys, "origin").agg(F.collect_list("part").alias("parts"))
    both = bits.join(held, [*keys, "origin"], "left").select(*keys, "origin", "dims", "bits", "parts")
    schema = _fields(both, keys, BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keep(rows: pa.RecordBatch) -> tuple[pa.Array]:
            origin, dims = (rows.column(c)[0].as_py() for c in ("origin", "dims"))
            masks, size, parts = _unpacked(rows.column("bits"), dims), int(np.prod(dims)), rows.column("parts")
            found = roots(masks != empty)
            name, row = parts.flatten().to_numpy(), pc.list_parent_indices(parts).to_numpy()
            at = [((name >> k * ORDER_BITS) & (1 << ORDER_BITS) - 1) - o for k, o in zip((2, 1, 0), origin)]
            here = np.all([(a >= 0) & (a < n) for a, n in zip(at, dims)], axis=0)
            chosen = np.zeros(masks.size + 1, bool)
            chosen[row[here] * size + np.ravel_multi_index([a[here] for a in at], dims)] = True
            chosen[-1] = False  # of voxels that are not set
            inside = chosen[found].reshape(masks.shape)
            return (_packed(inside | masks if empty else inside),)

        return _stacked(batches, [*keys, "origin", "dims"], arrow_schema(schema), ["origin", "dims"], ["bits"], keep)

    return both.mapInArrow(run, schema)


def largest(bits: DataFrame, volumes: DataFrame, keys: Sequence[str] = ("volume_id",), groups: int | None = None, side: int = BRICK_SIDE) -> DataFrame:
    """Bits of the biggest component; a tie goes to the one that starts first in the grid."""
    keys = list(keys)
    parts = components(bits, volumes, keys, groups=groups, side=side)
    sizes = parts.groupBy(*keys, "label").agg(F.sum("n").alias("n"))
    best = sizes.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b")).select(*keys, (-F.col("b.l")).alias("label"))
    return _chosen(bits, parts.join(best, [*keys, "label"], "left_semi"), keys, False)


def filled(bits: DataFrame, volumes: DataFrame, keys: Sequence[str] = ("volume_id",), groups: int | None = None, side: int = BRICK_SIDE) -> DataFrame:
    """Set voxels plus every background component that does not reach the border of the grid."""
    keys = list(keys)
    parts = components(bits, volumes, keys, True, groups, side)
    open_ = parts.where("border").select(*keys, "label").distinct()
    return _chosen(bits, parts.join(open_, [*keys, "label"], "left_anti"), keys, True)


def simple(packed: DataFrame, volumes: DataFrame, p: float = 10.0, keys: Sequence[str] = ("volume_id",), value: str = "value",
           groups: int | None = None, side: int = BRICK_SIDE) -> DataFrame:
    """Threshold, fill holes, erode once, dilate twice, keep the largest component."""
    keys = list(keys)
    cut = cut_lineage(threshold(packed, p, keys, value, groups), "bits")
    grown = cut_lineage(morph(filled(cut, volumes, keys, groups, side), volumes, [("erode", 1), ("dilate", 2)], keys, groups, side), "bits")
    return largest(grown, volumes, keys, groups, side)


def applied(packed: DataFrame, bits: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "value") -> DataFrame:
    """Samples outside the set, and of bricks without a mask, become 0."""
    keys = list(keys)
    both = packed.select(*keys, "origin", "dims", F.col(value).cast("array<double>").alias("value")).join(bits.select(*keys, "origin", "bits"), [*keys, "origin"], "left")
    schema = _fields(both, keys, T.StructField("value", T.ArrayType(T.DoubleType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(rows: pa.RecordBatch) -> tuple[pa.Array]:
            v, data = stacks.matrix(rows.column("value")), rows.column("bits")
            inside = 0 if data.null_count else _unpacked(data, [v.shape[1]])  # rows of one stack have bits all or none
            return (stacks.lists(v * inside, pa.list_(pa.float64())),)

        return _stacked(batches, [*keys, "origin", "dims"], arrow_schema(schema), [], ["value", "bits"], cut)

    return both.mapInArrow(run, schema).withColumnRenamed("value", value)


def set_voxels(bits: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Rows ``(keys, x, y, z)`` of the set, to look at or to hand to operators on voxels."""
    keys = list(keys)
    point = T.ArrayType(T.IntegerType())
    schema = T.StructType([*(bits.schema[k] for k in keys), *(T.StructField(c, point) for c in "xyz")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places(row: dict) -> tuple:
            return tuple((c + o).tolist() for c, o in zip(np.nonzero(_unpack(row["bits"], row["dims"])), row["origin"]))

        return _mapped(batches, keys, arrow_schema(schema), places)

    return bits.select(*keys, "origin", "dims", "bits").mapInArrow(run, schema).select(*keys, F.inline(F.arrays_zip("x", "y", "z")))
