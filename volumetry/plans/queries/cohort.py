"""Catalog, pairing, mask lookup and stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from volumetry.operators import catalog
from volumetry.plans import fixtures as fx
from volumetry.plans.registry import query
from volumetry.sources.cohort import layout_catalog, parse_sidecars
from volumetry.config import CohortConfig
from volumetry.sources.tables import table


@query("discover_paths", f"""with {fx.PATHS}
  select path, subject, session, modality, field_strength,
    regexp_replace(path, '/[^/]*$', '') as dir, concat(subject,'_',session,'_',modality,'_defaced.nii.gz') as file_name
  from paths""")
def discover_paths(spark, d):
    out = layout_catalog(fx.catalog(spark, d).select("path"), CohortConfig())
    return out.select("path", "subject", "session", "modality", "field_strength", "dir", "file_name")


@query("sidecar_json", """select event_id, cast(json_extract(props, '$.k') as bigint) as k from events""")
def sidecar_json(spark, d):
    parsed = parse_sidecars(table(spark, d, "events").select("event_id", F.col("props").alias("sidecar")), "sidecar")
    return parsed.select("event_id", F.try_variant_get("metadata", "$.k", "bigint").alias("k"))


@query("field_strength", """select event_type as session, case when event_type = 'view' then '3T'
  when event_type = 'click' then '7T' else 'unknown' end as field_strength, count(*) as n
  from events group by 1, 2""")
def field_strength(spark, d):
    df = table(spark, d, "events").select(F.col("event_type").alias("session"))
    marked = catalog.derive_field_strength(df, {"view": "3T", "click": "7T"})
    return marked.groupBy("session", "field_strength").agg(F.count(F.lit(1)).alias("n"))


@query("modality_match", """select page_id, case when contains(url, 'blog') then 'blog' when contains(url, '.html')
  then '.html' when contains(url, '/en/') then '/en/' end as modality from pages
  where contains(url, 'blog') or contains(url, '.html') or contains(url, '/en/')""")
def modality_match(spark, d):
    out = catalog.derive_modality(table(spark, d, "pages"), ["blog", ".html", "/en/"], "url")
    return out.select("page_id", "modality")


@query("parse_name", f"""with {fx.PATHS} select path, split_part(split_part(path, '/', 4), '_', 1) as subject,
  split_part(split_part(path, '/', 4), '_', 2) as session, split_part(path, '/', 1) as subject_dir,
  split_part(path, '/', 2) as session_dir from paths""")
def parse_name(spark, d):
    df = catalog.parse_path(fx.catalog(spark, d).select("path"))
    df = df.withColumnsRenamed({"subject": "subject_dir", "session": "session_dir"})
    return catalog.parse_name(df).select("path", "subject", "session", "subject_dir", "session_dir")


@query("output_names", f"""with {fx.PATHS} select path, replace(path, '_defaced', '_preprocessed') as output_path,
  replace(path, '_defaced', '_brain') as brain_path, replace(path, '_defaced', '_brain_mask') as mask_path
  from paths""")
def output_names(spark, d):
    return catalog.derive_paths(fx.catalog(spark, d).select("path"))


@query("pair_sessions", f"""with {fx.CAT} select a.subject, a.modality, a.volume_id as input, b.volume_id as target
  from cat a join cat b on a.subject = b.subject and a.modality = b.modality and a.session = 'ses-1'
  and b.session = 'ses-2'""")
def pair_sessions(spark, d):
    return catalog.paired(catalog.pair_sessions(fx.catalog(spark, d), "ses-1", "ses-2", item="volume_id"))


@query("pair_sessions_last", """select l_suppkey as subject, l_returnflag as modality,
  max(case when l_linestatus = 'F' then l_orderkey end) as input,
  max(case when l_linestatus = 'O' then l_orderkey end) as target
  from lineitem group by 1, 2 having input is not null and target is not null""")
def pair_sessions_last(spark, d):
    """Sessions seen many times: the last item wins."""
    df = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("modality"),
        F.col("l_linestatus").alias("session"), "l_orderkey")
    return catalog.paired(catalog.pair_sessions(df, "F", "O", item="l_orderkey"))


@query("unpaired_subjects", """select conv_id as subject, case when count(*) filter (where role='system') = 0
  then 'system' else 'assistant' end as missing from conversations where role in ('system', 'assistant')
  group by conv_id having count(distinct role) = 1""")
def unpaired_subjects(spark, d):
    df = table(spark, d, "conversations").select(
        F.col("conv_id").alias("subject"), F.col("role").alias("session"), "turn")
    found = catalog.pair_sessions(df, "system", "assistant", by=["subject"], item="turn")
    return catalog.unpaired(found, "system", "assistant")


@query("mask_lookup", """with images as (select doc_id, source as dir, concat('doc-', cast(doc_id as varchar)) as stem
    from documents),
  masks as (select d.source as dir, concat('doc-', cast(l.doc_id as varchar), '_brain_mask') as mask_name,
    concat(d.source, '/doc-', cast(l.doc_id as varchar), '_brain_mask.nii.gz') as mask_path
    from labels l join documents d using (doc_id)),
  named as (select i.doc_id, min(m.mask_path) as p from images i join masks m on i.dir = m.dir
    and contains(m.mask_name, i.stem) group by 1),
  anym as (select dir, min(mask_path) as p from masks group by 1)
  select i.doc_id, coalesce(n.p, a.p) as mask_path, case when n.p is not null then 'stem'
    when a.p is not null then 'folder' else 'none' end as mask_match
  from images i left join named n using (doc_id) left join anym a using (dir)""")
def mask_lookup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("dir"))
    stem = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    masks = table(spark, d, "labels").select("doc_id").join(docs, "doc_id").select(
        "dir", F.concat(stem, F.lit("_brain_mask")).alias("mask_name"),
        F.concat(F.col("dir"), F.lit("/"), stem, F.lit("_brain_mask.nii.gz")).alias("mask_path"))
    out = catalog.attach_masks(docs.withColumn("stem", stem), masks)
    return out.select("doc_id", "mask_path", "mask_match")


@query("missing_masks", """select source, count(*) as total, count(l.doc_id) as with_mask,
  count(*) - count(l.doc_id) as without_mask from documents d left join labels l using (doc_id) group by source""")
def missing_masks(spark, d):
    return catalog.verify_masks(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"], ["source"])


@query("pending_volumes", """select o_orderkey, o_orderstatus from orders where o_orderkey not in
  (select l_orderkey from lineitem)""")
def pending_volumes(spark, d):
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return catalog.pending(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), done, ["o_orderkey"])


@query("processing_status", """select d.lang, count(l.doc_id) as n_ok, count(*) as n_total
  from documents d left join labels l using (doc_id) group by d.lang""")
def processing_status(spark, d):
    marked = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn(
        "error", F.when(F.col("quality").isNull(), "no label"))
    return catalog.processing_status(marked, by=["lang"])


@query("stack_modalities", f"""with {fx.CAT}, {fx.VOX}
  select subject, session, x, y, z,
    round(coalesce(max(case when modality='T1w' then value end), 0), 6) as t1w,
    round(coalesce(max(case when modality='T2w' then value end), 0), 6) as t2w,
    round(coalesce(max(case when modality='FLAIR' then value end), 0), 6) as flair,
    'FLAIR' as missing
  from vox join cat using (volume_id) group by subject, session, x, y, z""")
def stack_modalities(spark, d):
    labelled = fx.packed(spark, d).join(
        fx.catalog(spark, d).select("volume_id", "subject", "session", "modality"), "volume_id").drop("volume_id")
    out = catalog.stack_modalities(labelled, ["T1w", "T2w", "FLAIR"])
    return out.select("subject", "session", "x", "y", "z", *[
        F.round(F.col("channels")[i], 6).alias(n) for i, n in enumerate(("t1w", "t2w", "flair"))
    ], F.array_join("missing", ",").alias("missing"))


@query("head_catalog", f"""with {fx.PATHS} select path, volume_id from paths order by path limit 5""")
def head_catalog(spark, d):
    return catalog.head(fx.catalog(spark, d).select("path", "volume_id"), 5, "path")
