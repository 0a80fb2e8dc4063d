"""Metric history by epoch and fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from volumetry.operators import splits, tracking
from volumetry.plans import fixtures as fx
from volumetry.plans.registry import query
from volumetry.schema import with_row
from volumetry.sources.tables import table


@query("epoch_means", f"""select cast(extract(day from ts) as int) as epoch, event_type as metric,
  round(avg(value),6) as value, count(*) as n_batches from events group by 1, 2""")
def epoch_means(spark, d):
    log = table(spark, d, "events").select(
        F.dayofmonth("ts").alias("epoch"), F.col("event_type").alias("metric"), "value")
    return tracking.epoch_means(log).withColumn("value", F.round("value", 6))


BEST = f"""with {fx.HISTORY}, m as (select *, min(value) over (partition by metric order by epoch
  rows between unbounded preceding and 1 preceding) as best from hist)"""


@query("is_best", f"""{BEST} select cast(epoch as int) as epoch, metric, round(value,6) as value,
  (best is null or value < best) as is_best from m""")
def is_best(spark, d):
    return tracking.mark_best(fx.history(spark, d)).withColumn("value", F.round("value", 6))


@query("best_epoch", f"""with {fx.HISTORY} select metric, cast(arg_min(epoch, value) as int) as best_epoch,
  round(min(value),6) as best_value from hist group by metric""")
def best_epoch(spark, d):
    return tracking.best_epoch(fx.history(spark, d)).withColumn("best_value", F.round("best_value", 6))


@query("checkpoint_epochs", f"""{BEST} select cast(epoch as int) as epoch, metric, (best is null or value < best)
  as is_best from m where epoch % 10 = 0 or best is null or value < best""")
def checkpoint_epochs(spark, d):
    return tracking.checkpoint_epochs(fx.history(spark, d), 10).drop("value")


@query("overfit_slope", f"""with {fx.HISTORY} select metric, count(*) as n_epochs,
  round(regr_slope(value, epoch), 8) as slope, (count(*) > 10 and regr_slope(value, epoch) > 0) as overfitting
  from hist group by metric""")
def overfit_slope(spark, d):
    return tracking.overfit(fx.history(spark, d)).withColumn("slope", F.round("slope", 8))


@query("metric_ratio", f"""with {fx.HISTORY} select cast(epoch as int) as epoch, round(max(case when metric='view'
  then value end) / (max(case when metric='click' then value end) + 1e-8), 6) as ratio from hist group by epoch""")
def metric_ratio(spark, d):
    return tracking.metric_ratio(fx.history(spark, d), "view", "click").withColumn("ratio", F.round("ratio", 6))


def _cv_sql(cols):
    return " union all ".join(
        f"select '{c}' as metric, round(avg({c}),6) as mean, round(stddev_pop({c}),6) as std from f" for c in cols)


@query("cv_summary", f"""with f as (select c_nationkey as fold, avg(c_acctbal) as acctbal, count(*) as n
  from customer group by 1) {_cv_sql(['acctbal', 'n'])}""")
def cv_summary(spark, d):
    folds = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("fold")).agg(
        F.avg("c_acctbal").alias("acctbal"), F.count(F.lit(1)).alias("n"))
    out = tracking.cv_summary(folds, ["fold", "acctbal", "n"])
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("run_summary", f"""with {fx.HISTORY}, s as (select metric, round(avg(value),4) as mean,
    round(stddev_pop(value),4) as std, round(min(value),4) as min, round(max(value),4) as max,
    cast(arg_min(epoch, value) as int) as best_epoch from hist group by metric)
  select 'run-1' as run, cast(to_json(list({{metric: metric, mean: mean, std: std, min: min, max: max,
    best_epoch: best_epoch}} order by metric)) as varchar) as summary from s""")
def run_summary(spark, d):
    return tracking.run_summary(fx.history(spark, d).withColumn("run", F.lit("run-1")))


@query("kfold_run", """with r as (select c_custkey, c_acctbal, row_number() over (order by md5(concat('42|',
    cast(c_custkey as varchar))), c_custkey) as rn, count(*) over () as n from customer),
  f as (select c_acctbal, cast(least(floor((rn-1) / floor(n/3.0)), 2) as int) as own from r)
  select k.fold, count(*) filter (where own <> fold) as n_train, count(*) filter (where own = fold) as n_val,
    round(avg(case when own <> fold then c_acctbal end) - avg(case when own = fold then c_acctbal end), 6) as gap
  from f, (select cast(unnest(range(3)) as int) as fold) k group by k.fold""")
def kfold_run(spark, d):
    """Folds by subject with a user function per fold; here the function stays a plan."""
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), "c_acctbal")
    rows = []

    def score(train, val):
        one = with_row(train.agg(F.count(F.lit(1)).alias("n_train"), F.avg("c_acctbal").alias("_t")),
                       val.agg(F.count(F.lit(1)).alias("n_val"), F.avg("c_acctbal").alias("_v")))
        return {"plan": one.select("n_train", "n_val", F.round(F.col("_t") - F.col("_v"), 6).alias("gap"))}

    for r in splits.run_kfold(cust, 3, score):
        rows.append(r["plan"].withColumn("fold", F.lit(r["fold"])))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
