"""Decoding, chains, and what is written and read back."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volumetry.config import PreprocessConfig
from volumetry.operators import qc, splits, stats
from volumetry.plans import fixtures as fx
from volumetry.plans.preprocess import preprocess
from volumetry.plans.queries.cohort_splits import SPLIT, order_sql
from volumetry.plans.queries.intensity import LIMITS
from volumetry.plans.queries.space import turned
from volumetry.plans.registry import query
from volumetry.session import cut_lineage, scratch_path
from volumetry.schema import voxels
from volumetry.sinks import report, writers
from volumetry.sources.volumes import bricks_of, decode_volumes
from volumetry.sources.tables import table


def file_bytes(cube: np.ndarray) -> bytes:
    """A minimal volume file around float32 samples: the input of the decoder."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, cube.ndim, *cube.shape, *[1] * (7 - cube.ndim))
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1.0, *[1.0] * 7)
    struct.pack_into("<3f", head, 108, 352.0, 0.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)
    head[344:348] = b"n+1\0"
    return bytes(head) + np.asarray(cube, dtype="<f4").tobytes(order="F")


def encoded(spark, d):
    def run(batches):
        for pdf in batches:
            cubes = [np.asarray(v, dtype="f4").reshape(4, 4, 4) for v in pdf["value"]]
            yield pdf[["volume_id"]].assign(content=[file_bytes(c) for c in cubes])

    return fx.packed(spark, d).select("volume_id", "value").mapInPandas(run, "volume_id long, content binary")


@query("ingest_roundtrip", f"with {fx.VOX} select volume_id, x, y, z, round(value, 6) as value from vox")
def ingest_roundtrip(spark, d):
    """Volume files decoded into bricks of side 3, so that a volume has several."""
    out = voxels(bricks_of(decode_volumes(encoded(spark, d), side=3)))
    return out.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("ingest_status", """select count(*) as n_ok, cast((select count(*) from embeddings) + (select count(*) from documents) as bigint) as n_total
  from embeddings""")
def ingest_status(spark, d):
    """Texts are no volumes: they come out as errors and stop nothing."""
    from volumetry.operators.catalog import processing_status
    texts = table(spark, d, "documents").select(
        (F.col("doc_id") + 1_000_000_000).alias("volume_id"), F.encode("text", "utf-8").alias("content"))
    decoded = decode_volumes(encoded(spark, d).unionByName(texts))
    return processing_status(decoded.where(F.col("brick") == 0))


@query("brick_roundtrip", f"with {fx.VOX} select volume_id, x, y, z, round(value, 6) as value from vox")
def brick_roundtrip(spark, d):
    """Long rows packed into bricks of side 2 and unpacked again."""
    from volumetry.schema import bricks
    out = voxels(bricks(voxels(fx.packed(spark, d)), side=2))
    return out.withColumn("value", F.round(F.col("value").cast("double"), 6))


PADDED = fx.POS.replace("pos as (select", "p0 as (select") + """,
  fl as (select volume_id, case when label < 5 then 3 - x else z end as x, case when label < 5 then y else 3 - x end as y,
    case when label < 5 then z else y end as z, value from p0 join embeddings on vec_id = volume_id),
  g as (select vec_id as volume_id, a.i::int as x, b.i::int as y, c.i::int as z from embeddings,
    (select unnest(range(6)) as i) a, (select unnest(range(3)) as i) b, (select unnest(range(5)) as i) c),
  pos as (select g.volume_id, g.x, g.y, g.z, coalesce(value, 0) as value from g left join fl v on v.volume_id = g.volume_id
    and v.x + 1 = g.x and v.y - 1 = g.y and v.z = g.z)"""


@query("preprocess_chain", f"""with {PADDED}, {LIMITS.format(src='pos')},
  s as (select volume_id, avg(cv) as m, stddev_pop(cv) as sd from c where cv > 0 group by 1)
  select volume_id, x, y, z, round(case when sd > 0 then (cv - m) / sd else cv end, 6) as value from c left join s using (volume_id)""")
def preprocess_chain(spark, d):
    cfg = PreprocessConfig(spacing=None, skull_strip=False, size=(6, 3, 5))
    out, _, _ = preprocess(fx.packed_pos(spark, d), turned(spark, d), cfg, groups=fx.volume_count(spark, d))
    return out.withColumn("value", F.round("value", 6))


@query("preprocess_full")
def preprocess_full(spark, d):
    """Every step on: simple mask, reorientation, finer grid, padding, normalisation; statistics out."""
    cfg = PreprocessConfig(spacing=(0.75, 0.75, 0.75), size=(6, 6, 6), normalization="percentile")
    lifted = fx.packed(spark, d).withColumn("value", F.transform(
        "value", lambda v: F.greatest(v.cast("double") + F.lit(0.3), F.lit(0.0))))
    _, _, found = preprocess(lifted, turned(spark, d), cfg, groups=fx.volume_count(spark, d))
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std", "min", "max", "median", "p01", "p99")})


@query("volume_metadata_json", f"""with {fx.PATHS}, {fx.VOX}, s as (select volume_id, round(avg(value),6) as mean, round(min(value),6) as min,
    round(max(value),6) as max from vox where value <> 0 group by 1)
  select volume_id, path as original_path, '[4,4,4]' as original_shape, mean, min, max, 'zscore' as normalization
  from s join paths using (volume_id)""")
def volume_metadata_json(spark, d):
    found = stats.moments(fx.packed(spark, d), ["volume_id"], where=lambda v: v != 0)
    rows = found.select("volume_id", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max")]).join(
        fx.headers(spark, d), "volume_id").join(fx.catalog(spark, d).select("volume_id", "path"), "volume_id")
    out = writers.volume_metadata(rows.withColumn("processed_shape", F.col("shape")), PreprocessConfig())
    at = lambda p: F.get_json_object("metadata", f"$.{p}")
    return out.select("volume_id", at("original_path").alias("original_path"), at("original_shape").alias("original_shape"),
                      *[at(f"statistics.{c}").cast("double").alias(c) for c in ("mean", "min", "max")],
                      at("preprocessing_config.normalization").alias("normalization"))


@query("split_roundtrip", f"with {fx.CAT}, {order_sql('cat')}, {SPLIT} select volume_id, subject, split from cat join sp using (subject)")
def split_roundtrip(spark, d):
    path = scratch_path(spark, "split")
    cat = fx.catalog(spark, d).select("volume_id", "subject")
    writers.write_split(splits.assign_split(cat, splits.split_subjects(cat)), path)
    return writers.read_split(spark, path, "volume_id long, subject string")


@query("metric_log_append", f"""with {fx.HISTORY} select 'run-1' as run, 'val' as split, cast(epoch as int) as epoch, metric,
  round(value, 6) as value from hist union all select 'run-2', 'val', cast(epoch as int), metric, round(value / 2, 6) from hist""")
def metric_log_append(spark, d):
    path = scratch_path(spark, "metric-log")
    log = fx.history(spark, d).withColumns({"run": F.lit("run-1"), "split": F.lit("val"), "value": F.round("value", 6)})
    writers.append_metrics(log, path)
    second = fx.history(spark, d).withColumns({"run": F.lit("run-2"), "split": F.lit("val"), "value": F.round(F.col("value") / 2, 6)})
    writers.append_metrics(second, path)
    return spark.read.schema("split string, epoch int, metric string, value double, run string").parquet(path)


@query("eval_table", """select c_mktsegment as subject, printf('%.6f', avg(c_acctbal)) as psnr_input, count(*) as n
  from customer group by 1""")
def eval_table(spark, d):
    per = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("subject")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("psnr_input"))
    return writers.eval_table(per)


def flagged(spark, d):
    rows = qc.qc_metrics(fx.line_samples(spark, d), groups=fx.supplier_count(spark, d))
    found = cut_lineage(rows)
    return cut_lineage(qc.flag_outliers(found, qc.detect_outliers(found)))


@query("qc_summary_json")
def qc_summary_json(spark, d):
    rows = flagged(spark, d)
    return writers.qc_summary_json(rows, qc.qc_summary(rows))


def numeric_columns(rows, item="volume_id"):
    return [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != item]


@query("qc_report_html")
def qc_report_html(spark, d):
    rows = flagged(spark, d)
    lines = report.qc_report(rows, qc.qc_summary(rows), stats.describe_exact(rows, numeric_columns(rows)))
    return lines.where(F.col("key") != "~")
