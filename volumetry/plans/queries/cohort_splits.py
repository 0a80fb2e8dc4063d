"""Subject splits, folds, batches and leakage checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from volumetry.operators import catalog, splits
from volumetry.plans import fixtures as fx
from volumetry.plans.registry import query
from volumetry.sources.tables import table


def order_sql(src: str, subject: str = "subject", seed: int = 42) -> str:
    return f"""r as (select {subject} as subject, row_number() over (order by md5(concat('{seed}|',
      cast({subject} as varchar))), {subject}) as rn, count(*) over () as n
      from (select distinct {subject} from {src}) q)"""


SPLIT = """sp as (select subject, case when rn <= floor(n * cast(0.6 as double)) then 'train'
  when rn <= floor(n * cast(0.6 as double)) + floor(n * cast(0.2 as double)) then 'val' else 'test' end as split
  from r)"""


@query("subject_split", f"with {fx.CAT}, {order_sql('cat')}, {SPLIT} select * from sp")
def subject_split(spark, d):
    return splits.split_subjects(fx.catalog(spark, d))


@query("customer_split", f"with {order_sql('customer', 'c_custkey')}, {SPLIT} select * from sp")
def customer_split(spark, d):
    return splits.split_subjects(table(spark, d, "customer").select(F.col("c_custkey").alias("subject")))


@query("kfold_assign", f"""with {fx.CAT}, {order_sql('cat')},
  f as (select subject, cast(least(floor((rn-1) / floor(n/5.0)), 4) as int) as own from r),
  k as (select cast(unnest(range(5)) as int) as fold)
  select subject, fold, case when own = fold then 'val' else 'train' end as role from f, k""")
def kfold_assign(spark, d):
    return splits.fold_roles(splits.kfold_subjects(fx.catalog(spark, d), 5), 5)


@query("split_counts", f"""with {fx.CAT}, {order_sql('cat')}, {SPLIT}
  select split, modality, count(*) as n from cat join sp using (subject) group by 1, 2""")
def split_counts(spark, d):
    cat = fx.catalog(spark, d)
    return splits.assign_split(cat, splits.split_subjects(cat)).groupBy("split", "modality").agg(
        F.count(F.lit(1)).alias("n"))


@query("pair_split", f"""with {fx.CAT}, {order_sql('cat')}, {SPLIT}
  select a.subject, a.modality, a.volume_id as input, b.volume_id as target, split
  from cat a join cat b on a.subject = b.subject and a.modality = b.modality and a.session='ses-1'
  and b.session='ses-2' join sp on sp.subject = a.subject""")
def pair_split(spark, d):
    pairs = catalog.paired(catalog.pair_sessions(fx.catalog(spark, d), "ses-1", "ses-2", item="volume_id"))
    return splits.assign_split(pairs, splits.split_subjects(pairs))


@query("split_summary", f"""with {order_sql('conversations', 'conv_id')}, {SPLIT}
  select split, cast(count(*) as bigint) as n_samples, count(distinct conv_id) as n_subjects,
    round(count(*) / (select count(*) from conversations), 6) as share
  from conversations c join sp on sp.subject = c.conv_id group by split""")
def split_summary(spark, d):
    conv = table(spark, d, "conversations").select(F.col("conv_id").alias("subject"), "turn")
    out = splits.split_summary(splits.assign_split(conv, splits.split_subjects(conv)))
    return out.withColumn("share", F.round("share", 6))


@query("leakage_check", """select conv_id as subject, string_agg(distinct role, ',' order by role) as splits
  from conversations group by conv_id having count(distinct role) > 1""")
def leakage_check(spark, d):
    """A split by role instead of by conversation leaks; the report names every leaked one."""
    conv = table(spark, d, "conversations").select(F.col("conv_id").alias("subject"), F.col("role").alias("split"))
    return splits.leakage(conv).withColumn("splits", F.array_join("splits", ","))


@query("leakage_none", f"""with {fx.CAT}, {order_sql('cat')}, {SPLIT}
  select subject, 'x' as splits from cat join sp using (subject) group by subject having count(distinct split) > 1""")
def leakage_none(spark, d):
    cat = fx.catalog(spark, d)
    out = splits.leakage(splits.assign_split(cat, splits.split_subjects(cat)))
    return out.withColumn("splits", F.array_join("splits", ","))


@query("batch_assign", """select o_orderkey, cast(floor((row_number() over (order by md5(concat('42|',
  cast(o_orderkey as varchar))), o_orderkey) - 1) / 16.0) as bigint) as batch from orders""")
def batch_assign(spark, d):
    return splits.to_batches(table(spark, d, "orders").select("o_orderkey"), 16, "o_orderkey")


@query("batch_assign_in_order", """select o_orderkey, cast(floor((row_number() over (order by o_orderkey) - 1) / 16.0)
  as bigint) as batch from orders""")
def batch_assign_in_order(spark, d):
    return splits.to_batches(table(spark, d, "orders").select("o_orderkey"), 16, "o_orderkey", shuffle=False)
