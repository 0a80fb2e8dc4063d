"""Writers of bricks, metadata, splits, metrics and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetry.config import PreprocessConfig
from volumetry.operators.evaluate import EVAL_FIRST


def write_bricks(bricks: DataFrame, path: str, by: Sequence[str] = ("modality", "session")) -> None:
    """Brick table partitioned by catalog fields, so later reads prune folders."""
    bricks.write.mode("overwrite").partitionBy(*by).parquet(path)


def checkpoint_stage(df: DataFrame, name: str, path: str) -> DataFrame:
    """Writes an intermediate stage and goes on from the stored table."""
    target = f"{path}/{name}"
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.parquet(target)


def volume_metadata(volumes: DataFrame, cfg: PreprocessConfig) -> DataFrame:
    """One JSON record per volume from ``path, shape, processed_shape`` and its statistics columns."""
    stats = [c for c in ("mean", "std", "min", "max", "median", "p01", "p99") if c in volumes.columns]
    settings = F.struct(
        F.lit(cfg.orientation).alias("orientation"),
        (F.array(*[F.lit(s) for s in cfg.spacing]) if cfg.spacing else F.lit(None).cast("array<double>")).alias("spacing"),
        F.lit(cfg.normalization).alias("normalization"), F.lit(cfg.skull_strip).alias("skull_stripping"))
    record = F.struct(
        F.col("path").alias("original_path"), F.col("shape").alias("original_shape"), "processed_shape",
        F.struct(*stats).alias("statistics"), settings.alias("preprocessing_config"))
    return volumes.select("volume_id", F.to_json(record).alias("metadata"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_split(df: DataFrame, path: str) -> None:
    """Catalog rows as JSON lines, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def read_split(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Split rows with the given columns; ``split`` comes from the folder names."""
    return spark.read.schema(f"{schema}, split string").json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def eval_table(df: DataFrame, first: Sequence[str] = EVAL_FIRST) -> DataFrame:
    """Leading columns first, numbers with six decimals as text."""
    order = [c for c in first if c in df.columns]
    order += [c for c in df.columns if c not in order]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def shown(c: str) -> Column:
        return F.format_string("%.6f", F.col(c).cast("double")).alias(c) if kinds[c] in ("double", "float") else F.col(c)

    return df.select(*[shown(c) for c in order])


def write_eval(df: DataFrame, path: str) -> None:
    write_metrics(eval_table(df), path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Adds rows ``(run, split, epoch, metric, value)`` to the log."""
    df.select("run", "split", "epoch", "metric", "value").write.mode("append").partitionBy("run").parquet(path)


def qc_summary_json(flagged: DataFrame, summary: DataFrame) -> DataFrame:
    """JSON lines: the totals first, then one line per volume; no list is gathered on one row."""
    top = summary.select(F.lit("summary").alias("kind"), F.to_json(F.struct(*summary.columns)).alias("json"))
    rows = flagged.select(F.lit("volume").alias("kind"), F.to_json(F.struct(*flagged.columns)).alias("json"))
    return top.unionByName(rows)
