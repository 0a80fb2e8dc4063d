"""Neighbourhood operators on bricks.

Each brick sends the slabs its neighbours need and is then worked on as one padded block. Only
bricks and thin slabs are shuffled, once, whatever the size of the neighbourhood; a group is one
brick with at most 26 slabs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volumetry.schema import BRICK_SIDE

OFFSETS = [o for o in product((-1, 0, 1), repeat=3) if any(o)]
HELD_SAMPLES = 2_000_000

Block = Callable[[dict[str, np.ndarray], dict[str, object]], Mapping[str, object]]


def stencil(packed: DataFrame, fn: Block, outputs: Mapping[str, str], reach: int,
            keys: Sequence[str] = ("volume_id",), values: Sequence[str] = ("value",),
            params: Sequence[str] = (), side: int = BRICK_SIDE) -> DataFrame:
    """Calls ``fn(blocks, params)`` per brick; blocks are padded by ``reach`` on each side, NaN outside
    the grid. ``params["_inside"]`` are the slices of a block that lie inside the grid, so padding and a
    NaN sample are told apart. ``outputs`` maps names to ``double``, ``long`` or ``array<double>`` (C
    order, the size of the brick). A brick that lacks one of its values gives null outputs and sends
    nothing. Returns ``keys, origin, dims, outputs``."""
    if reach > side:
        raise ValueError(f"a reach of {reach} does not fit bricks of side {side}")
    keys, values, params = list(keys), list(values), list(params)
    at = lambda i: F.floor(F.col("origin")[i] / side).cast("int")
    home = packed.select(
        *keys, *params, at(0).alias("bx"), at(1).alias("by"), at(2).alias("bz"), F.lit(True).alias("center"), "origin", "dims",
        *[F.col(v).cast("array<double>").alias(v) for v in values])
    inner_edge = F.exists("origin", lambda o: o > 0) | F.exists("dims", lambda n: n >= side)
    for v in values:
        inner_edge = inner_edge & F.col(v).isNotNull()
    pieces = home.unionByName(home.where(inner_edge).mapInArrow(_cutter(home.columns, values, reach, side), home.schema))
    fields = [f for f in home.schema.fields if f.name in (*keys, "origin", "dims")]
    schema = T.StructType(fields + [T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs.items()])
    names = [f.name for f in fields]
    return pieces.groupBy(*keys, "bx", "by", "bz").applyInArrow(_worker(fn, outputs, names, values, params, reach), schema)


def _cutter(columns: list[str], values: list[str], reach: int, side: int):
    def slabs(row: dict) -> Iterator[dict]:
        origin, dims = row["origin"], row["dims"]
        for off in OFFSETS:
            if not all(o == 0 or (o == 1 and n >= side) or (o == -1 and s > 0) for o, n, s in zip(off, dims, origin)):
                continue
            cut = [(0, n) if o == 0 else (max(n - reach, 0), n) if o == 1 else (0, min(reach, n)) for o, n in zip(off, dims)]
            yield part_of(row, cut, values) | {"center": False} | {b: row[b] + o for b, o in zip(("bx", "by", "bz"), off)}

    return scatter(columns, values, slabs)


def part_of(row: dict, cut: Sequence[tuple[int, int]], values: Sequence[str]) -> dict:
    """The box ``cut`` of a brick row, with its own origin and dims."""
    place = tuple(slice(*c) for c in cut)
    return {**row, "origin": [s + c[0] for s, c in zip(row["origin"], cut)], "dims": [b - a for a, b in cut],
            **{v: np.asarray(row[v]).reshape(row["dims"])[place].reshape(-1) for v in values}}


def scatter(columns: Sequence[str], values: Sequence[str], pieces: Callable[[dict], Iterator[dict]],
            schema: pa.Schema | None = None):
    """A ``mapInArrow`` function that turns each brick row into pieces, in batches of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, kind = [], 0, schema or batch.schema
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values.to_numpy() if c in values else batch.column(c)[i].as_py() for c in columns}
                for piece in pieces(row):
                    held.append(piece)
                    size += len(piece[values[0]]) * len(values)
                    if size >= HELD_SAMPLES:
                        yield pa.RecordBatch.from_pylist(held, schema=kind)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=kind)

    return run


def _worker(fn: Block, outputs: Mapping[str, str], names: list[str], values: list[str], params: list[str], reach: int):
    def run(rows: pa.Table) -> pa.Table:
        center = np.flatnonzero(rows.column("center").to_numpy())
        if len(center) == 0:  # slabs sent past the last brick
            return pa.table({n: pa.array([], rows.schema.field(n).type) for n in names} | {
                n: pa.array([], _arrow(t)) for n, t in outputs.items()})
        home = rows.slice(int(center[0]), 1)
        if any(rows.column(v).null_count for v in values):
            return pa.table({n: home.column(n) for n in names} | {n: pa.nulls(1, _arrow(t)) for n, t in outputs.items()})
        start, dims = (np.array(home.column(c)[0].as_py()) for c in ("origin", "dims"))
        blocks = {v: np.full(dims + 2 * reach, np.nan) for v in values}
        first, last = np.full(3, reach), dims + reach
        for i in range(rows.num_rows):
            origin, size = rows.column("origin")[i].as_py(), rows.column("dims")[i].as_py()
            low = np.array(origin) - start + reach
            place = tuple(slice(a, a + n) for a, n in zip(low, size))
            first, last = np.minimum(first, low), np.maximum(last, low + np.array(size))
            for v in values:
                blocks[v][place] = rows.column(v)[i].values.to_numpy().reshape(size)
        inside = tuple(slice(int(a), int(b)) for a, b in zip(first, last))
        made = fn(blocks, {p: home.column(p)[0].as_py() for p in params} | {"_inside": inside})
        return pa.table({n: home.column(n) for n in names} | {
            n: pa.array([np.asarray(made[n]).reshape(-1)] if t.startswith("array") else [made[n]], _arrow(t))
            for n, t in outputs.items()})

    return run


def _arrow(kind: str) -> pa.DataType:
    return {"double": pa.float64(), "long": pa.int64(), "array<double>": pa.list_(pa.float64())}[kind]


def line_sums(block: np.ndarray, weights: Sequence[Sequence[float]]) -> np.ndarray:
    """Separable weighted sums: one shifted addition per tap and axis; the padding is used up."""
    for axis, w in enumerate(weights):
        n = block.shape[axis] - len(w) + 1
        total = 0.0
        for k, c in enumerate(w):
            if c:
                total = total + c * block[(slice(None),) * axis + (slice(k, k + n),)]
        block = total
    return block
