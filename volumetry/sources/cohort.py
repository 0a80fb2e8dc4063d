"""Cohort discovery and JSON sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetry.config import CohortConfig
from volumetry.operators.catalog import (
    DEFACED_FILE, SIDECAR_FILE, derive_field_strength, derive_modality, parse_path,
)


def layout_catalog(paths: DataFrame, cfg: CohortConfig, path: str = "path") -> DataFrame:
    """Catalog rows of the paths that follow ``sub-*/ses-*/anat/<file>``; others are dropped."""
    parsed = parse_path(paths, path).where(
        F.col("subject").startswith("sub-") & F.col("session").startswith("ses-")
        & F.col("dir").endswith("/anat"))
    strengths = {cfg.session_3t: "3T", cfg.session_7t: "7T"}
    return derive_modality(derive_field_strength(parsed, strengths), cfg.modalities)


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Paths below ``root`` whose file name matches; the content column is never read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(root)
    )
    return files.select("path", "length", "modificationTime")


def discover(spark: SparkSession, root: str, cfg: CohortConfig | None = None) -> DataFrame:
    """Catalog of a cohort folder, with an id that depends on the path below ``sub-*`` only."""
    cfg = cfg or CohortConfig()
    found = layout_catalog(list_files(spark, root, cfg.file_pattern), cfg)
    below = F.concat_ws("/", "subject", "session", "file_name")
    return found.withColumn("volume_id", F.xxhash64(below))


def parse_sidecars(df: DataFrame, text: str) -> DataFrame:
    """``metadata`` VARIANT from JSON text; unreadable or missing text becomes ``{}``."""
    parsed = F.coalesce(F.try_parse_json(F.col(text)), F.parse_json(F.lit("{}")))
    return df.withColumn("metadata", parsed)


def attach_sidecars(spark: SparkSession, catalog: DataFrame, root: str) -> DataFrame:
    """Joins ``<stem>.json`` of the same folder to each catalog row."""
    texts = (
        spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{SIDECAR_FILE}").load(root)
        .select(F.col("_metadata.file_path").alias("sidecar_path"), F.col("value").alias("sidecar"))
    )
    wanted = F.replace(F.col("path"), F.lit(DEFACED_FILE), F.lit(SIDECAR_FILE))
    # both sides may or may not carry the scheme of the file system
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    joined = catalog.withColumn("_key", plain(wanted)).join(
        texts.withColumn("_key", plain(F.col("sidecar_path"))), "_key", "left").drop("_key")
    return parse_sidecars(joined, "sidecar")
