"""Table shapes and the two physical forms of a volume.

long   : one row per sample, ``(keys..., x, y, z, value)``.
packed : one row per brick, ``value`` is an ARRAY in C order with ``origin`` and ``dims``
         (ARRAY<INT>). A whole small volume is one brick.

Every statistic operator takes either form. Parameters are joined to packed rows before
they are unpacked, so a join moves bricks, never single samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volumetry.session import cut_lineage

BRICK_SIDE = 64

# A parameter table is broadcast only when its caller can bound its rows by this number
# (at most ~100 bytes a row); past it the same join runs as a shuffled join.
BROADCAST_ROWS = 1_000_000


def is_packed(df: DataFrame, value: str = "value") -> bool:
    return isinstance(df.schema[value].dataType, T.ArrayType)


def samples(df: DataFrame, value: str = "value") -> DataFrame:
    """Long rows without coordinates: all that an order-free statistic needs."""
    if not is_packed(df, value):
        return df
    rest = [c for c in df.columns if c not in (value, "origin", "dims")]
    return df.select(*rest, F.explode(value).alias(value))


def voxels(df: DataFrame, value: str = "value") -> DataFrame:
    """Long rows with coordinates ``x, y, z`` from C-order positions."""
    if not is_packed(df, value):
        return df
    rest = [c for c in df.columns if c not in (value, "origin", "dims")]
    at = lambda name, i: F.col(name).getItem(i)
    flat = df.select(*rest, "origin", "dims", F.posexplode(value).alias("_pos", value))
    plane = at("dims", 1) * at("dims", 2)
    whole = lambda a, b: F.floor(a / b).cast("int")
    return flat.select(
        *rest,
        (at("origin", 0) + whole(F.col("_pos"), plane)).alias("x"),
        (at("origin", 1) + whole(F.col("_pos"), at("dims", 2)) % at("dims", 1)).alias("y"),
        (at("origin", 2) + F.col("_pos") % at("dims", 2)).alias("z"),
        value,
    )


def bricks(df: DataFrame, keys: Sequence[str] = ("volume_id",), value: str | Sequence[str] = "value",
           side: int = BRICK_SIDE) -> DataFrame:
    """Pack long rows of dense volumes; a group never holds more than ``side**3`` samples."""
    names = [value] if isinstance(value, str) else list(value)
    cell = lambda c: F.floor(F.col(c) / side).cast("int")
    keyed = df.withColumns({"bx": cell("x"), "by": cell("y"), "bz": cell("z")})
    packed = keyed.groupBy(*keys, "bx", "by", "bz").agg(
        *[F.min(c).alias(f"_{c}0") for c in "xyz"],
        *[F.max(c).alias(f"_{c}1") for c in "xyz"],
        F.sort_array(F.collect_list(F.struct("x", "y", "z", *names))).alias("_cells"),
    )
    return packed.select(
        *keys,
        F.array(*[F.col(f"_{c}0") for c in "xyz"]).alias("origin"),
        F.array(*[F.col(f"_{c}1") - F.col(f"_{c}0") + 1 for c in "xyz"]).alias("dims"),
        *[F.col(f"_cells.{n}").alias(n) for n in names],
    )


def attach(df: DataFrame, params: DataFrame, keys: Sequence[str], rows: int | None = None,
           how: str = "left") -> DataFrame:
    """Joins parameters to the rows of a volume or sample table.

    ``rows`` is an upper bound of the parameter rows that the caller can prove. Without one the
    parameters are stored first: the planner then knows their size and broadcasts them, or shuffles
    both sides, before any sample is moved.
    """
    if keys and rows is None:
        params = cut_lineage(params, "params")
    return combine(df, params, keys, rows, how)


def combine(df: DataFrame, params: DataFrame, keys: Sequence[str], rows: int | None = None,
            how: str = "left") -> DataFrame:
    """The same join between two tables of the same small kind; nothing is stored."""
    if not keys:
        return with_row(df, params)
    small = rows is not None and rows <= BROADCAST_ROWS
    return df.join(F.broadcast(params) if small else params, list(keys), how)


def with_row(df: DataFrame, params: DataFrame) -> DataFrame:
    """Adds the columns of a one-row table as a scalar subquery: no join, no shuffle."""
    row = params.select(F.struct(*params.columns).alias("_row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, "_row.*")


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def positive(v: Column) -> Column:
    """``v > 0`` with the numpy reading of NaN (Spark sorts NaN above every number)."""
    return (v > 0) & ~F.isnan(v)
