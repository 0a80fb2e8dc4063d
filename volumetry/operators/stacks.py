"""Rows of equal geometry as one numpy stack, and groups of rows inside a task.

A cohort has many volumes and few shapes. Work on bricks that agree in shape, place and map is done on all of
them at once, at most ``HELD`` samples (one full brick) a stack, so a row costs its samples and no Python calls
of its own. Rows that agree with no other are stacks of one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volumetry.schema import BRICK_SIDE

HELD = BRICK_SIDE**3
SENT = 2_000_000  # samples of a batch that goes on

Stack = Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]


def _codes(column: pa.Array) -> np.ndarray:
    """Number columns for a column of short lists: equal rows have equal bytes."""
    lengths = pc.list_value_length(column)
    if column.null_count == 0 and pc.count_distinct(lengths).as_py() == 1 and column.flatten().null_count == 0:
        return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)
    return np.unique(np.array([repr(x) for x in column.to_pylist()]), return_inverse=True)[1].reshape(-1, 1).astype("float64")


def _sizes(column: pa.Array) -> np.ndarray:
    """Length of each value of lists or bytes, -1 of a null."""
    size = pc.binary_length(column) if pa.types.is_binary(column.type) else pc.list_value_length(column)
    return size.fill_null(-1).to_numpy(zero_copy_only=False).astype("float64").reshape(-1, 1)


def places(batch: pa.RecordBatch, same: Sequence[str], sized: Sequence[str] = ()) -> list[np.ndarray]:
    """Rows that agree in the lists ``same`` and in the lengths of ``sized``, together."""
    if batch.num_rows < 2:
        return [np.arange(batch.num_rows)] if batch.num_rows else []
    rows = np.ascontiguousarray(np.hstack([*(_codes(batch.column(c)) for c in same), *(_sizes(batch.column(c)) for c in sized)]))
    _, code = np.unique(rows.view(f"V{rows.shape[1] * 8}").reshape(-1), return_inverse=True)
    order = np.argsort(code, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(code[order])) + 1)


def stacked(batch: pa.RecordBatch, same: Sequence[str], sized: Sequence[str], size: Callable[[pa.RecordBatch], int], fn: Stack) -> Iterator[pa.RecordBatch]:
    """What ``fn`` gives for each stack of a batch; ``size`` tells the samples that one of its rows holds."""
    for rows in places(batch, same, sized):
        most = max(1, HELD // max(1, size(batch.slice(int(rows[0]), 1))))
        for at in range(0, len(rows), most):
            yield from fn(batch.take(pa.array(rows[at:at + most])))


def sent(made: Iterator[pa.RecordBatch], value: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches, of ``SENT`` samples of the column ``value`` about."""
    held, n = [], 0
    for batch in made:
        held.append(batch)
        n += len(batch.column(value).flatten()) if value else batch.num_rows
        if n >= SENT:
            yield from _one(held)
            held, n = [], 0
    if held:
        yield from _one(held)


def _one(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A column of lists of equal length, one for each row."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.reshape(-1), kind.value_type)).cast(kind)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows of one matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def in_groups(df: DataFrame, columns: Sequence[str], shapes: DataFrame, shape: str, schema: T.StructType, work: Callable[..., Iterator[pa.RecordBatch]],
              kind: pa.Schema) -> DataFrame:
    """``work(alone, groups)`` on the rows that agree in ``columns``: those that are a group by themselves, as one batch, and
    each other group. Groups meet in buckets by their hash, of about ``HELD`` samples each by the grids of ``shapes``: a full
    brick has its own, and small ones share one."""
    total = shapes.agg(F.sum(F.aggregate(shape, F.lit(1.0), lambda a, n: a * n))).first()[0] or 0
    columns, buckets = list(columns), max(1, math.ceil(total / HELD))

    def run(rows: pa.Table) -> pa.Table:
        held = rows.drop_columns(["_bucket"]).sort_by([(c, "ascending") for c in columns]).combine_chunks().to_batches()
        start = _starts(held[0], columns) if held else np.zeros(0, "int64")
        return pa.Table.from_batches(work(*alone(held[0], start)) if held else [], schema=kind)

    return df.withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets))).groupBy("_bucket").applyInArrow(run, schema)


def _starts(rows: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    n = rows.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        a, b = rows.column(c).slice(0, n - 1), rows.column(c).slice(1)
        other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(a.type):  # NaN is one key
            other = other & ~pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False)
        new[1:] |= other | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return np.flatnonzero(new)


def alone(rows: pa.RecordBatch, start: np.ndarray) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
    """The rows that are a group by themselves, and each other group."""
    end = np.append(start[1:], rows.num_rows)
    one = end - start == 1
    return rows.take(pa.array(start[one])), [rows.slice(int(a), int(b - a)) for a, b in zip(start[~one], end[~one])]
