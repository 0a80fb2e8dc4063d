"""Exact ranks and percentiles that never sort or collect one group in one task.

A group may hold a third of all rows, so no operator here orders a whole group. Values are cut
into a bounded number of monotone cells, cells are counted with map-side combine, and only the
cells that matter are ordered, each by itself, after equal values were merged into counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volumetry.functions.binning import cell_of
from volumetry.schema import BROADCAST_ROWS, attach, combine, finite, samples
from volumetry.session import cut_lineage

CELLS = 1024
CELL_ROWS = 100_000  # rows of one group that a task orders
SPLITS = 64
HASH_BUCKETS = 4096  # three hex digits of an md5

Keep = Callable[[Column], Column]


def before(keys: Sequence[str], order: str) -> Window:
    """All rows of the group that come before the current one."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _measures(measures: dict[str, Column]) -> list[Column]:
    return [F.sum(m).alias(k) for k, m in measures.items()]


def steps(df: DataFrame, keys: Sequence[str], value: str, measures: dict[str, Column], choose: Callable[[], Column],
          where: Keep = finite, groups: int | None = None, bounds: DataFrame | None = None,
          closed: bool = True, carry: dict[str, Column] | None = None) -> DataFrame:
    """Groups cut into intervals of values that follow each other: ``(keys..., _vlo, _vhi, _opened)``, every
    measure summed, ``<name>_before`` (its sum over all smaller values) and ``<name>_total``.

    ``choose`` names, from those columns, the intervals that matter. They are opened into one row per distinct
    value; the others stay whole, or are left out with ``closed=False``. ``carry`` names columns made with the
    choice, which the rows of an opened interval keep. No task orders more than about
    ``CELL_ROWS`` rows of a group: the first cut is one by arithmetic, and a chosen interval above that
    number is cut again at the quantiles of its own sketch, where a value that fills a whole quantile
    gets an interval to itself. So the last pass stays even for any distribution of values."""
    keys = list(keys)
    v = F.col(value).cast("double")
    if bounds is None:
        bounds = samples(df, value).where(where(F.col(value))).groupBy(*keys).agg(
            F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    cell = cell_of(v, F.col("_lo"), F.col("_hi"), CELLS)
    carry = carry or {}

    def rows(joined: DataFrame) -> DataFrame:
        return samples(joined, value).where(where(F.col(value))).withColumn("_cell", cell)

    def chosen(parts: DataFrame) -> DataFrame:
        held = F.coalesce(choose(), F.lit(False))
        marked = parts.withColumn("_held", held)
        marked = (marked if closed else marked.where("_held")).withColumns(carry)
        return cut_lineage(marked.withColumn("_open", F.col("_held") & (F.col("_vlo") < F.col("_vhi"))).drop("_held"), "steps")

    def in_cells(some: DataFrame, n: int) -> DataFrame:
        """Rows in the cells of intervals that were not cut again."""
        params = some.groupBy(*keys).agg(
            F.collect_list("_cell").alias("_ids"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        return rows(combine(df, params, keys, n, "inner")).where(F.array_contains("_ids", F.col("_cell")))

    def inside(some: DataFrame, n: int, *more: str) -> DataFrame:
        """Rows in one of the given intervals (``_in``), found by their cell first."""
        lists = some.groupBy(*keys, "_cell").agg(
            F.collect_list(F.struct("_vlo", "_vhi", *more)).alias("_list"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        params = lists.groupBy(*keys).agg(F.collect_list(F.struct("_cell", "_list")).alias("_l"), F.min("_lo").alias("_lo"),
                                          F.max("_hi").alias("_hi"))
        params = params.select(*keys, "_lo", "_hi", F.col("_l._cell").alias("_ids"), F.col("_l._list").alias("_lists"))
        at = F.array_position("_ids", F.col("_cell")).cast("int")
        near = rows(combine(df, params, keys, n, "inner")).withColumn("_at", at).where(F.col("_at") > 0)
        own = F.get(F.filter(F.get("_lists", F.col("_at") - 1), lambda p: (v >= p["_vlo"]) & (v <= p["_vhi"])), F.lit(0))
        return near.withColumn("_in", own).where(F.col("_in").isNotNull())

    def follow(found: DataFrame, parents: DataFrame, order: str, n: int) -> DataFrame:
        """Sums before each row: those before its parent and those inside it."""
        inner = [c for c in (*keys, "_cell", "_plo") if c in found.columns]
        kept = [f"{k}_{end}" for k in measures for end in ("before", "total")]
        own = parents.withColumn("_plo", F.col("_vlo")).select(*inner, "_lo", "_hi", *kept, *carry)
        joined = combine(found, own, inner, n, "inner")
        return joined.withColumns({f"{k}_before": F.col(f"{k}_before") + F.coalesce(
            F.sum(k).over(before(inner, order)), F.lit(0)) for k in measures})

    ends = attach(df, bounds, keys, groups, "inner")
    counts = rows(ends).groupBy(*keys, "_cell").agg(
        F.count(F.lit(1)).alias("_c"), F.min(v).alias("_vlo"), F.max(v).alias("_vhi"),
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), *_measures(measures))
    parts = chosen(counts.select(
        "*", *[F.coalesce(F.sum(k).over(before(keys, "_cell")), F.lit(0)).alias(f"{k}_before") for k in measures],
        *[F.sum(k).over(Window.partitionBy(*keys)).alias(f"{k}_total") for k in measures]))
    large, again = F.col("_open") & (F.col("_c") > CELL_ROWS), False
    while True:
        n_open, n_large = parts.agg(F.count_if("_open"), F.count_if(large)).first()
        if n_large == 0:
            break
        again, heavy = True, parts.where(large)
        shares = [i / SPLITS for i in range(1, SPLITS)]
        sketch = inside(heavy, n_large).groupBy(*keys, "_cell", F.col("_in._vlo").alias("_vlo")).agg(
            F.percentile_approx(v, shares, 1000).alias("_cuts"))
        cuts = heavy.join(cut_lineage(sketch, "sketch"), [*keys, "_cell", "_vlo"])
        # an odd place is a cut itself, an even one lies between two cuts
        place = F.size(F.filter("_in._cuts", lambda c: c < v)) + F.size(F.filter("_in._cuts", lambda c: c <= v))
        finer = inside(cuts, n_large * SPLITS, "_cuts").groupBy(
            *keys, "_cell", F.col("_in._vlo").alias("_plo"), place.alias("_place")).agg(
            F.count(F.lit(1)).alias("_c"), F.min(v).alias("_vlo"), F.max(v).alias("_vhi"), *_measures(measures))
        rest = parts.where(~large).drop("_open", *carry)
        parts = chosen(rest.unionByName(follow(finer, heavy, "_place", n_large).drop("_plo", "_place", *carry)))
    whole = parts.where(~F.col("_open")).withColumn("_opened", F.lit(False))
    shape = [*keys, "_vlo", "_vhi", *[f"{k}{end}" for k in measures for end in ("", "_before", "_total")], *carry, "_opened"]
    if n_open == 0:
        return whole.select(*shape)
    opening = parts.where("_open")
    found, parent = (inside(opening, n_open), [F.col("_in._vlo").alias("_plo")]) if again else (in_cells(opening, n_open), [])
    values = found.groupBy(*keys, "_cell", *parent, v.alias("_vlo")).agg(*_measures(measures))
    opened = follow(values, opening, "_vlo", n_open).withColumns({"_vhi": F.col("_vlo"), "_opened": F.lit(True)})
    return whole.select(*shape).unionByName(opened.select(*shape))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float],
                where: Keep = finite, groups: int | None = None, exact: bool = True,
                accuracy: int = 10_000, bounds: DataFrame | None = None) -> DataFrame:
    """``(keys..., n, pct)``: linear-interpolated percentiles as an array in the order of ``ps``.
    ``bounds`` (``keys..., _lo, _hi``) saves a pass where the ends of the kept values are known."""
    keys = list(keys)
    kept = df.select(*keys, value)
    if not exact:
        probs = F.array(*[F.lit(p / 100.0) for p in ps])
        return (
            samples(kept, value).where(where(F.col(value))).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.percentile_approx(F.col(value).cast("double"), probs, accuracy).alias("pct"))
        )
    shares = F.expr("array(" + ", ".join(f"{p / 100.0!r}D" for p in ps) + ")")

    def place(q: Column, n: Column) -> Column:
        return q * (n - 1).cast("double")

    def among(ranks: Column) -> Column:
        end = F.col("m_before") + F.col("m")
        return F.filter(ranks, lambda r: (r >= F.col("m_before")) & (r < end))

    n = F.col("m_total")
    asked = F.flatten(F.transform(shares, lambda q: F.array(
        F.floor(place(q, n)).cast("long"), F.ceil(place(q, n)).cast("long"))))
    # an interval keeps the asked ranks that fall into it, so its values look at those only
    cut = steps(kept, keys, value, {"m": F.lit(1)}, lambda: F.size(among(asked)) > 0, where, groups, bounds, closed=False,
                carry={"_ranks": F.array_distinct(among(asked))})
    found = cut.select(*keys, n.alias("n"), "_vlo", F.explode(among(F.col("_ranks"))).alias("_r"))
    picked = found.groupBy(*keys).agg(
        F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_r", "_vlo"))).alias("_at"))
    if not keys:
        picked = picked.where(F.col("n").isNotNull())

    def interpolate(pos: Column) -> Column:
        low, high = (F.element_at("_at", f(pos).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (pos - F.floor(pos))

    return picked.select(*keys, "n", F.transform(shares, lambda q: interpolate(place(q, F.col("n")))).alias("pct"))


def hash_rank(df: DataFrame, digest: Column, ties: Sequence[str], keys: Sequence[str] = (),
              name: str = "rn", total: str | None = None) -> DataFrame:
    """``row_number`` in md5 order within ``keys`` (or over everything), spread over 4096 buckets."""
    keys = list(keys)
    marked = df.withColumn("_digest", digest).withColumn(
        "_bucket", F.conv(F.substring("_digest", 1, 3), 16, 10).cast("int")
    )
    counts = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_c").over(before(keys, "_bucket")), F.lit(0)).alias("_start"),
        *([F.sum("_c").over(Window.partitionBy(*keys)).alias(total)] if total else []),
    )
    bucket_keys = keys + ["_bucket"]
    joined = combine(marked, starts, bucket_keys, None if keys else HASH_BUCKETS, "inner")
    local = Window.partitionBy(*bucket_keys).orderBy("_digest", *ties)
    return joined.withColumn(name, F.row_number().over(local) + F.col("_start")).drop(
        "_digest", "_bucket", "_start"
    )


BOTTOM = 10_000  # sampled rows a group that one task takes from every other


def hash_sample(df: DataFrame, digest: Column, ties: Sequence[str], n: int,
                keys: Sequence[str] = ()) -> DataFrame:
    """Exactly ``min(n, size)`` rows of each group without replacement: the smallest digests. Up to ``BOTTOM``
    rows a group, each task keeps its own n smallest and sends no more; beyond, digests are cut into buckets."""
    keys = list(keys)
    if n <= BOTTOM and not keys:
        return df.withColumn("_digest", digest).orderBy("_digest", *ties).limit(n).drop("_digest")
    if n <= BOTTOM:
        every = Window.partitionBy(*keys).orderBy("_digest", *ties)
        ranked = df.withColumn("_digest", digest).withColumn("_rn", F.row_number().over(every))
        return ranked.where(F.col("_rn") <= n).drop("_digest", "_rn")
    marked = df.withColumn("_digest", digest).withColumn(
        "_bucket", F.conv(F.substring("_digest", 1, 3), 16, 10).cast("int")
    )
    counts = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_c").over(before(keys, "_bucket")), F.lit(0)).alias("_start"),
    ).where(F.col("_start") < n)
    bucket_keys = keys + ["_bucket"]
    near = combine(marked, starts, bucket_keys, None if keys else HASH_BUCKETS, "inner")
    local = Window.partitionBy(*bucket_keys).orderBy("_digest", *ties)
    ranked = near.withColumn("_rn", F.row_number().over(local) + F.col("_start"))
    return ranked.where(F.col("_rn") <= n).select(df.columns)


assert HASH_BUCKETS <= BROADCAST_ROWS
