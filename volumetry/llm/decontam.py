"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed once; every run of ``gram`` words gets a hash from them. Of each ``window + 1 - gram``
neighbouring run hashes the smallest is kept (ties all), so two texts that share ``window`` words keep a
common run inside that span. Kept runs of the documents meet those of the benchmark in one join; each
meeting is then extended word by word to both sides, and a span of ``window`` words or more is a hit.
Every window of the span holds a kept run of its own, so looking ``window - gram`` words to either side
finds all of it.

A benchmark text shorter than the window is one window of its own length. All runs of such a length are
looked up (only for lengths that occur, at most ``window - 1``).

Rows are made with ``explode_outer``: for ``explode`` the planner adds a filter on the size of the array
and pushes it below the columns it is made of, which then are computed anew for each element.
Neighbours are brought together by shifted copies of whole arrays; ``slice`` inside a lambda would copy
the array for each element.

Scale: a document row makes its kept runs and one row of its own totals, which pass the join and meet in
one sum per document; texts are not shuffled. The planner sends the benchmark side to the executors if
its size allows and shuffles both sides if not. Word equality is equality of 64-bit hashes.

Rules: null is a text without words. Rows that agree in id and text get the same result, each its own
row. A benchmark row with null id counts as an item but can't be named. Columns of other names are left
out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
GRAM = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# ASCII besides digits and letters parts words; everything beyond ASCII is a part of one.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    plain = F.octet_length(text) == F.char_length(text)
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), GAPS), "")


def sliding(df: DataFrame, column: str, width: int, both: Callable[[Column, Column], Column]) -> DataFrame:
    """Replaces an array by ``both`` over each ``width`` neighbours, in as many projections as doubling
    takes; ends where the neighbours do. ``both`` may see overlapping parts, so it must not mind."""
    have = 1
    while have < width:
        step = min(have, width - have)
        rest = F.greatest(F.size(column) - step, F.lit(0))
        df = df.withColumn(column, F.zip_with(F.slice(column, 1, rest), F.slice(column, step + 1, rest), both))
        have += step
    return df


def with_runs(df: DataFrame, out: str, length: int) -> DataFrame:
    """Adds the hash of each run of ``length`` words: the hash of its two halves, which overlap if the
    length is no power of two."""
    return sliding(df.withColumn(out, F.col("_hashes")), out, length, lambda a, b: F.xxhash64(a, b))


def hashed(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    out = df.select(*keep, words(F.col(text)).alias("_words"))
    return out.select(*keep, F.size("_words").alias("n_words"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))


def anchored(df: DataFrame, keep: list[str], window: int, gram: int) -> DataFrame:
    """Adds ``_kept`` to ``hashed`` rows: hash, position and words around of each run that is smallest in a
    window. A run is one if it equals the largest of the smallest hashes of the windows that hold it."""
    width, side = window - gram + 1, window - gram
    out = with_runs(df, "_runs", gram)
    out = sliding(out.withColumn("_top", F.col("_runs")), "_top", width, lambda a, b: F.least(a, b))
    ends = F.array_repeat(F.lit(-(1 << 63)), width - 1)
    out = out.withColumn("_top", F.when(F.size("_top") > 0, F.concat(ends, F.col("_top"), ends)).otherwise(F.array().cast("array<bigint>")))
    out = sliding(out, "_top", width, lambda a, b: F.greatest(a, b))

    def full(p: Column) -> Column:
        near = F.array(*[F.get("_hashes", p + k) for k in range(-side, gram + side)])
        return F.struct(F.get("_runs", p).alias("hash"), p.alias("at"), near.alias("near"))

    places = F.filter(F.transform("_runs", lambda h, p: F.when(h == F.get("_top", p), p)), lambda p: p.isNotNull())
    out = out.withColumn("_places", F.when(F.size("_top") > 0, places))
    return out.select(*keep, F.transform("_places", full).alias("_kept"))


def extended(a: Column, b: Column, window: int, gram: int) -> tuple[Column, Column]:
    """Words that agree to the left and to the right of a run; null if the run itself differs."""
    side = window - gram
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    reach = lambda part: F.when(F.array_contains(part, False), F.array_position(part, F.lit(False)) - 1).otherwise(F.size(part))
    core = F.forall(F.slice(same, side + 1, gram), lambda x: x)
    return (F.when(core, reach(F.reverse(F.slice(same, 1, side)))), F.when(core, reach(F.slice(same, side + gram + 1, side))))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_words, spans`` (disjoint hit spans of words, start and
    end) and ``items`` (sorted names of the items with a window in it). ``text_hash`` tells rows of one id
    apart."""
    items = hashed(benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")), ["item"], "text")
    short = items.where(f"n_words between 1 and {window - 1}")
    lengths = sorted(r[0] for r in short.select("n_words").distinct().collect())  # window - 1 numbers at most

    keys = ["doc_id", "text_hash"]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_hash"), F.col(text).alias("text"))
    made = hashed(rows, keys, "text")
    nothing = F.lit(None).cast("array<bigint>")
    plain = lambda h, p: F.struct(h.alias("hash"), p.alias("at"), nothing.alias("near"))
    for n in lengths:
        made = with_runs(made, f"_of_{n}", n)
    also = [f"_of_{n}" for n in lengths]
    kept = anchored(made, [*keys, "n_words", *also], window, gram)
    total = F.struct(F.xxhash64("text_hash", "doc_id").alias("hash"), F.lit(-1).alias("at"), nothing.alias("near"))
    none = F.array().cast("array<struct<hash:bigint,at:int,near:array<bigint>>>")
    runs = F.concat(F.array(total), F.coalesce("_kept", none), *[F.transform(c, plain) for c in also])
    probes = kept.select(*keys, "n_words", F.explode_outer(runs).alias("r")).select(*keys, "n_words", "r.*")

    long = anchored(items.where(f"n_words >= {window}"), ["item"], window, gram)
    known = long.select("item", F.explode_outer("_kept").alias("r")).where("r is not null").select(
        F.col("r.hash").alias("hash"), F.col("r.near").alias("item_near"), "item", F.lit(0).alias("length"))
    for n in lengths:
        whole = with_runs(short.where(F.col("n_words") == n), "_whole", n)
        known = known.union(whole.select(F.get("_whole", F.lit(0)), nothing, "item", F.lit(n)))
    # one row per run, however many items and places hold it
    known = known.groupBy("hash", "length", "item_near").agg(F.collect_set(F.coalesce(F.col("item").cast("string"), F.lit(""))).alias("names"))

    left, right = extended(F.col("near"), F.col("item_near"), window, gram)
    met = probes.join(known, "hash", "left").select(
        *keys, "n_words", "at", "names", "length", left.alias("l"), right.alias("r"))
    hit = F.when((F.col("length") > 0) & (F.col("at") >= 0), F.struct(F.col("at").alias("start"), (F.col("at") + F.col("length")).alias("end"))).when(
        F.col("l") + F.col("r") + gram >= window,
        F.struct((F.col("at") - F.col("l")).alias("start"), (F.col("at") + gram + F.col("r")).alias("end")))
    met = met.select(*keys, "n_words", "at", F.when(hit.isNotNull(), F.col("names")).alias("names"), hit.cast("struct<start:int,end:int>").alias("hit"))
    met = met.where("at < 0 or hit is not null")
    whole = met.groupBy(*keys).agg(
        F.max("n_words").alias("n_words"), F.collect_set("hit").alias("_hits"),
        F.array_distinct(F.flatten(F.collect_set("names"))).alias("_items"),
        F.sum(F.when(F.col("at") < 0, 1).otherwise(0)).alias("_rows"))
    start = F.array().cast("array<struct<start:int,end:int>>")
    joined = F.aggregate(
        F.array_sort("_hits"), start,
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1),
                     F.array(F.struct(F.element_at(done, -1)["start"].alias("start"),
                                      F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(x))))
    spans = F.when(F.size("_hits") > 0, joined).otherwise(start)
    out = whole.select(*keys, "n_words", spans.alias("spans"), F.array_sort("_items").alias("items"), "_rows")
    return out.select(*keys, "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_copy")).drop("_copy")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a hit, in full."""
    found = contamination(docs, benchmark, doc_id, text).where("size(spans) > 0").select("doc_id", "text_hash").distinct()
    same = docs[doc_id].eqNullSafe(found["doc_id"]) & (F.coalesce(F.xxhash64(docs[text]), F.lit(0)) == found["text_hash"])
    return docs.join(found, same, "left_anti")
