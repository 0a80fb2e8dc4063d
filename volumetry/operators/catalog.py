"""Cohort catalog: fields from names, pairing of sessions, mask lookup, stacking of modalities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetry.schema import voxels

# Fixed values of the cohort layout.
DEFACED = "_defaced"
PREPROCESSED = "_preprocessed"
BRAIN = "_brain"
BRAIN_MASK = "_brain_mask"
DEFACED_FILE = "_defaced.nii.gz"
SIDECAR_FILE = ".json"
UNKNOWN = "unknown"


def parts(path: Column, i: int) -> Column:
    """The i-th part of a path from its end, starting at 1."""
    return F.try_element_at(F.split(path, "/"), F.lit(-i))


def parse_path(df: DataFrame, path: str = "path") -> DataFrame:
    """Directory, file name, and subject / session from ``subject/session/anat/file``."""
    p = F.col(path)
    return df.withColumns({
        "dir": F.regexp_replace(p, "/[^/]*$", ""), "file_name": parts(p, 1),
        "subject": parts(p, 4), "session": parts(p, 3),
    })


def parse_name(df: DataFrame, name: str = "file_name") -> DataFrame:
    """Subject and session from the first two fields of a file name."""
    fields = F.split(F.col(name), "_")
    return df.withColumns({
        "subject": F.try_element_at(fields, F.lit(1)), "session": F.try_element_at(fields, F.lit(2))
    })


def derive_field_strength(df: DataFrame, strengths: Mapping[str, str], session: str = "session") -> DataFrame:
    """Maps the session to a scanner strength, ``unknown`` elsewhere."""
    chosen = F.lit(UNKNOWN)
    for name, strength in reversed(list(strengths.items())):
        chosen = F.when(F.col(session) == name, strength).otherwise(chosen)
    return df.withColumn("field_strength", chosen)


def derive_modality(df: DataFrame, modalities: Sequence[str], name: str = "file_name") -> DataFrame:
    """First listed modality found inside the file name; other rows are dropped."""
    hits = [F.when(F.col(name).contains(m), m) for m in modalities]
    return df.withColumn("modality", F.coalesce(*hits)).where(F.col("modality").isNotNull())


def derive_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Output, brain and mask names that belong to an input path."""
    return df.withColumns({
        "output_path": F.replace(F.col(path), F.lit(DEFACED), F.lit(PREPROCESSED)),
        "brain_path": F.replace(F.col(path), F.lit(DEFACED), F.lit(BRAIN)),
        "mask_path": F.replace(F.col(path), F.lit(DEFACED), F.lit(BRAIN_MASK)),
    })


def pair_sessions(df: DataFrame, first: str, second: str, by: Sequence[str] = ("subject", "modality"),
                  session: str = "session", item: str = "path", order: str | None = None) -> DataFrame:
    """Both sessions of a subject and modality in one aggregation instead of a self-join; a
    session seen twice keeps its last item in ``order``. One side may be null, see ``paired``."""
    order = order or item

    def last(name: str) -> Column:
        mine = F.col(session) == name
        return F.max_by(F.when(mine, F.col(item)), F.when(mine, F.col(order)))

    return df.where(F.col(session).isin(first, second)).groupBy(*by).agg(
        last(first).alias("input"), last(second).alias("target")
    )


def paired(df: DataFrame) -> DataFrame:
    return df.where(F.col("input").isNotNull() & F.col("target").isNotNull())


def unpaired(df: DataFrame, first: str, second: str) -> DataFrame:
    """Groups that lack a session, with the name of the missing one."""
    gap = F.when(F.col("input").isNull(), first).when(F.col("target").isNull(), second)
    return df.withColumn("missing", gap).where(F.col("missing").isNotNull()).drop("input", "target")


def pending(df: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without an output yet."""
    return df.join(done, list(on), "left_anti")


def verify_masks(df: DataFrame, masks: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """How many items have a mask, and how many lack one."""
    have = masks.select(*on).distinct().withColumn("_has", F.lit(True))
    return df.join(have, list(on), "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count("_has").alias("with_mask"),
        (F.count(F.lit(1)) - F.count("_has")).alias("without_mask"),
    )


def attach_masks(images: DataFrame, masks: DataFrame, folder: str = "dir", stem: str = "stem",
                 mask_name: str = "mask_name", mask: str = "mask_path") -> DataFrame:
    """A mask of the same folder whose name contains the image stem, else any mask of the folder.

    "Contains" becomes an equality: each mask name is cut into its substrings of the lengths that the
    stems of its folder have (few, and bounded by the length of a name) and reduced to one row per
    folder and substring, so no image ever meets all masks of its folder. Ties take the first path.
    """
    lengths = images.where(F.length(stem) > 0).groupBy(folder).agg(F.collect_set(F.length(stem)).alias("_lengths"))
    sized = masks.join(lengths, folder).select(folder, mask_name, mask, F.explode("_lengths").alias("_n")).where(
        F.col("_n") <= F.length(mask_name))
    starts = F.sequence(F.lit(1), F.length(mask_name) - F.col("_n") + 1)
    cut = sized.select(folder, mask, "_n", mask_name, F.explode(starts).alias("_i")).select(
        folder, mask, F.substring(F.col(mask_name), F.col("_i"), F.col("_n")).alias(stem))
    named = cut.groupBy(folder, stem).agg(F.min(mask).alias("_named"))
    any_mask = masks.groupBy(folder).agg(F.min(mask).alias("_any"))
    found = images.join(named, [folder, stem], "left").join(any_mask, folder, "left")
    return found.withColumn(mask, F.coalesce("_named", "_any")).withColumn(
        "mask_match", F.when(F.col("_named").isNotNull(), "stem").when(F.col("_any").isNotNull(), "folder")
        .otherwise("none")
    ).drop("_named", "_any")


def stack_modalities(df: DataFrame, modalities: Sequence[str], by: Sequence[str] = ("subject", "session"),
                     value: str = "value") -> DataFrame:
    """One row per sample position with the values of all modalities in the asked order, 0 where
    a modality is missing; the missing ones are named."""
    coords = [c for c in ("x", "y", "z") if c in voxels(df, value).columns]
    picked = {m: F.max(F.when(F.col("modality") == m, F.col(value).cast("double"))) for m in modalities}
    wide = voxels(df, value).groupBy(*by, *coords).agg(*[c.alias(f"_{m}") for m, c in picked.items()])
    cols = [F.col(f"_{m}") for m in modalities]
    return wide.select(
        *by, *coords, F.array(*[F.coalesce(c, F.lit(0.0)) for c in cols]).alias("channels"),
        F.array_compact(F.array(*[F.when(c.isNull(), m) for m, c in zip(modalities, cols)])).alias("missing"),
    )


def processing_status(df: DataFrame, error: str = "error", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.when(F.col(error).isNull(), 1)).alias("n_ok"), F.count(F.lit(1)).alias("n_total")
    )


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)
