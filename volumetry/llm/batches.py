"""Arrow batches in tasks: pieces of bounded size in, some columns kept, new ones added; samples by hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text bytes that one call of a function sees; a longer single text is a piece of its own.
PIECE_BYTES = 8 << 20
HASHES = 1 << 62  # steps of a sampled share; fine enough for any number of rows


def chosen(value: Column, sample: int, total: int) -> Column:
    """Whether a 64-bit hash is in the share that keeps about ``sample`` of ``total`` values; all of them
    if there are no more."""
    if total <= sample:
        return F.lit(True)
    return F.pmod(value, F.lit(HASHES)) < F.lit(HASHES * sample // total)


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def add_columns(df: DataFrame, column: str, fields: Sequence[T.StructField], fn: Callable[[list], list[pa.Array]],
                keep: Sequence[str] | None = None, binary: bool = False) -> DataFrame:
    """The kept columns of ``df`` (all by default) and ``fields``, which ``fn`` makes from the values of
    ``column`` (``bytes`` if asked for). A kept column with the name of a new one gives way to it."""
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    source = df.select(*dict.fromkeys([*kept, column]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column):
                values = piece.column(column)
                if binary:
                    values = values.cast(pa.binary())
                made = fn(values.to_pylist())
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), *made], names=schema.names)

    return source.mapInArrow(run, schema)
