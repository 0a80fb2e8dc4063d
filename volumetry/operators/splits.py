"""Subject-level splits and folds that hold for any partitioning and row order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volumetry.config import check_ratios
from volumetry.functions.hashing import digest
from volumetry.operators.ordering import CELLS, hash_rank
from volumetry.schema import with_row

SPLITS = ("train", "val", "test")
SPREAD = 64  # parts of the rows that share one key


def ordered_subjects(df: DataFrame, subject: str = "subject", seed: int = 42) -> DataFrame:
    """Distinct subjects with their place ``rn`` in the seeded order and their number ``n``."""
    return hash_rank(df.select(subject).distinct(), digest(seed, F.col(subject)), [subject], total="n")


def _share(ratio: float) -> Column:
    return F.floor(F.col("n").cast("double") * F.lit(float(ratio)))


def split_subjects(df: DataFrame, ratios: Sequence[float] = (0.6, 0.2, 0.2), subject: str = "subject",
                   seed: int = 42) -> DataFrame:
    """``(subject, split)``; train and val take the whole part of their share, test the rest."""
    check_ratios(*ratios)
    train, val, _ = ratios
    label = F.when(F.col("rn") <= _share(train), SPLITS[0]).when(
        F.col("rn") <= _share(train) + _share(val), SPLITS[1]).otherwise(SPLITS[2])
    return ordered_subjects(df, subject, seed).select(subject, label.alias("split"))


def kfold_subjects(df: DataFrame, k: int, subject: str = "subject", seed: int = 42) -> DataFrame:
    """``(subject, fold)``: blocks of ``n // k`` subjects, the last fold takes the remainder."""
    if k < 1:
        raise ValueError("k must be positive")
    size = F.floor(F.col("n") / F.lit(float(k)))
    fold = F.when(size == 0, F.lit(k - 1)).otherwise(
        F.least(F.floor((F.col("rn") - 1) / F.greatest(size, F.lit(1))), F.lit(k - 1)))
    return ordered_subjects(df, subject, seed).select(subject, fold.cast("int").alias("fold"))


def fold_roles(folds: DataFrame, k: int) -> DataFrame:
    """Every subject once per fold: ``val`` in its own fold, ``train`` in the others."""
    every = folds.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    role = F.when(F.col("_k") == F.col("fold"), "val").otherwise("train")
    return every.select(*[c for c in folds.columns if c != "fold"], F.col("_k").alias("fold"), role.alias("role"))


def assign_split(df: DataFrame, splits: DataFrame, subject: str = "subject") -> DataFrame:
    return df.join(splits, subject, "inner")


def leakage(df: DataFrame, subject: str = "subject", split: str = "split") -> DataFrame:
    """Subjects that occur in more than one split; empty when the split is sound."""
    seen = df.select(subject, split).distinct().groupBy(subject).agg(
        F.sort_array(F.collect_list(split)).alias("splits"))
    return seen.where(F.size("splits") > 1)


def split_summary(df: DataFrame, subject: str = "subject", split: str = "split") -> DataFrame:
    """Rows, subjects and share of all rows per split."""
    per = df.groupBy(split, subject).agg(F.count(F.lit(1)).alias("_n")).groupBy(split).agg(
        F.sum("_n").alias("n_samples"), F.count(F.lit(1)).alias("n_subjects"))
    total = per.agg(F.sum("n_samples").alias("_total"))
    return with_row(per, total).withColumn(
        "share", F.col("n_samples") / F.col("_total")).drop("_total")


def to_batches(df: DataFrame, size: int, key: str, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """Batch number of each row; shuffled order is the seeded one, else that of the key."""
    if shuffle:
        ranked = hash_rank(df, digest(seed, F.col(key)), [key])
    else:
        ranked = range_rank(df, key)
    return ranked.withColumn("batch", F.floor((F.col("rn") - 1) / F.lit(float(size)))).drop("rn")


def range_rank(df: DataFrame, key: str) -> DataFrame:
    """``row_number`` in the order of a numeric key without one global sort; null keys come first.

    Rows are cut at the quantiles of a sketch of the keys. Rows equal to a cut are a cell of their own that
    any order fits, so a key that fills many rows is spread over ``SPREAD`` parts."""
    shares = [i / CELLS for i in range(1, CELLS)]
    found = with_row(df, df.agg(F.percentile_approx(key, shares, 10 * CELLS).alias("_cuts")))
    # one expression, not a chain of projections: the filter that the join below infers would unfold a chain
    halves = F.array(*[F.lit(CELLS >> i) for i in range(1, CELLS.bit_length())])
    place = F.aggregate(halves, F.lit(0), lambda at, step: at + F.when(F.get("_cuts", at + step - 1) <= F.col(key), step).otherwise(0))
    placed = found.withColumn("_at", place)
    equal = F.col(key).isNull() | F.coalesce(F.get("_cuts", F.col("_at") - 1) == F.col(key), F.lit(False))
    cell = F.when(F.col(key).isNull(), -1).otherwise(2 * F.col("_at") - equal.cast("int"))
    part = F.when(equal, F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD))).otherwise(0)
    celled = placed.select(*df.columns, cell.alias("_cell"), part.alias("_part"))
    counts = celled.groupBy("_cell", "_part").agg(F.count(F.lit(1)).alias("_c"))
    first = Window.orderBy("_cell", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_cell", "_part", F.coalesce(F.sum("_c").over(first), F.lit(0)).alias("_start"))
    local = Window.partitionBy("_cell", "_part").orderBy(key)
    return celled.join(F.broadcast(starts), ["_cell", "_part"]).withColumn(
        "rn", F.row_number().over(local) + F.col("_start")).select(*df.columns, "rn")


def run_kfold(df: DataFrame, k: int, fn: Callable[[DataFrame, DataFrame], dict], subject: str = "subject",
              seed: int = 42) -> list[dict]:
    """Calls ``fn(train, val)`` for each fold and tags what it returns; one small dict per fold."""
    placed = df.join(kfold_subjects(df, k, subject, seed), subject)
    out = []
    for fold in range(k):
        train = placed.where(F.col("fold") != fold).drop("fold")
        val = placed.where(F.col("fold") == fold).drop("fold")
        out.append({**fn(train, val), "fold": fold})
    return out
