"""The preprocessing chain of a cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetry.config import PreprocessConfig
from volumetry.operators import bitmasks, grid, masks, stats
from volumetry.operators.normalize import normalize
from volumetry.schema import BRICK_SIDE, bricks, is_packed
from volumetry.session import cut_lineage


def stripped(packed: DataFrame, volumes: DataFrame, mask: DataFrame | None = None, groups: int | None = None, side: int = BRICK_SIDE) -> DataFrame:
    """Bricks multiplied by the voxels of the given mask where a volume has one, else by its simple mask."""
    if mask is None:
        return bitmasks.applied(packed, bitmasks.simple(packed, volumes, groups=groups, side=side))
    have = mask.select("volume_id").distinct()
    given, rest = packed.join(have, "volume_id", "left_semi"), packed.join(have, "volume_id", "left_anti")
    done = masks.apply_mask(given, masks.packed_mask(mask, given, side)).withColumn("value", F.col("value").cast("array<double>"))
    return done.select("volume_id", "origin", "dims", "value").unionByName(stripped(rest, volumes, None, groups, side))


def preprocess(df: DataFrame, volumes: DataFrame, cfg: PreprocessConfig | None = None, mask: DataFrame | None = None,
               groups: int | None = None, side: int = BRICK_SIDE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mask, reorient, resample, pad or crop, normalise, then statistics, in that order.

    Returns long samples, headers and statistics. Of packed volumes the samples stay in bricks up to the
    normalisation: the mask meets them as bricks, and the steps between are one map and one exchange of
    boxes. The spatial result is stored before it is normalised, as normalisation reads it several times.
    """
    cfg = cfg or PreprocessConfig()
    rows, heads = df, volumes
    clip = (cfg.clip_lower, cfg.clip_upper) if cfg.clip_values else None
    ways = {"method": cfg.normalization, "lower": cfg.percentile_lower, "upper": cfg.percentile_upper, "clip_range": clip, "groups": groups}
    if is_packed(df):
        if cfg.skull_strip:
            rows = stripped(df, heads, mask, groups, side)
        rows, heads = grid.fitted(rows, heads, cfg.orientation, cfg.spacing, cfg.interpolation, cfg.size, groups=groups, side=side)
        out = normalize(cut_lineage(rows), **ways)
        return out, heads, stats.volume_stats(out, groups=groups)
    if cfg.skull_strip:
        rows = masks.skull_strip(rows, heads, mask, groups=groups)
    rows, heads = grid.reorient(rows, heads, cfg.orientation, groups=groups)
    if cfg.spacing:
        rows, heads = grid.resample(rows, heads, cfg.spacing, cfg.interpolation, groups=groups)
    if cfg.size:
        rows, heads = grid.pad_or_crop(rows, heads, cfg.size, groups=groups)
    stored = cut_lineage(bricks(rows))
    out = normalize(stored, **ways)
    return out, heads, stats.volume_stats(out, groups=groups)
