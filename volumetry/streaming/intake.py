"""Incremental intake: each new volume file is catalogued and checked exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from volumetry.config import CohortConfig
from volumetry.operators.qc import qc_metrics
from volumetry.session import cut_lineage
from volumetry.sources.cohort import layout_catalog
from volumetry.sources.volumes import bricks_of, decode_volumes, failures_of

FILES = "path string, modificationTime timestamp, length long, content binary"


def qc_batch(files: DataFrame, cfg: CohortConfig) -> tuple[DataFrame, DataFrame]:
    """Metrics with catalog fields, and failures, of one batch of files."""
    below = F.concat_ws("/", "subject", "session", "file_name")
    known = layout_catalog(files, cfg).withColumn("volume_id", F.xxhash64(below))
    decoded = cut_lineage(decode_volumes(known))
    fields = known.select("volume_id", "path", "subject", "session", "modality", "field_strength")
    return qc_metrics(bricks_of(decoded), volumes=fields), failures_of(decoded)


def stream_qc(spark: SparkSession, in_dir: str, out: str, checkpoint: str, cfg: CohortConfig | None = None,
              files_per_batch: int = 1000) -> StreamingQuery:
    """Takes all files that are there now, in bounded batches, and stops. A batch overwrites its own
    folder, so a batch that is run again after a failure leaves its rows once."""
    cfg = cfg or CohortConfig()
    files = (
        spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", cfg.file_pattern)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(in_dir)
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        metrics, failed = qc_batch(batch, cfg)
        metrics.write.mode("overwrite").parquet(f"{out}/metrics/batch={batch_id}")
        failed.write.mode("overwrite").parquet(f"{out}/failures/batch={batch_id}")

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
