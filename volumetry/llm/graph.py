"""Connected components of a distributed edge list by alternating star rounds.

A large star hangs every larger neighbour of a node on the smallest node it sees; a small star does so
with the smaller ones. Repeated, every component becomes one star around its smallest node, in a number
of rounds that grows with the logarithm of its size. Each round is two joins of the edges with one
minimum per node (summed up before the shuffle); no node's neighbours are gathered in one place, so a
hub is split like any skewed join key. Rounds are written to the shared folder, and the table before
the last one is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetry.session import remove, scratch_path


def _star(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``edges`` (u, v) hang ``v`` on the smallest node around ``u``."""
    return edges.join(low, "u").select(F.col("m").alias("u"), F.col("v"))


def _round(edges: DataFrame) -> DataFrame:
    """One large and one small star; edges are (u, v) with u < v before and after."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = _star(both.where("v > u"), low).where("u < v").distinct()
    # small star: around v, its smaller neighbours u and v itself hang on the smallest of them
    down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    small = _star(down, least).union(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
    return small.where("u < v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of an edge list ``(u, v)``; the root is the smallest node of the
    component. Loops are ignored; repeated edges and both directions are fine. Nulls are ignored."""
    spark = edges.sparkSession
    schema = edges.select("u", "v").schema
    path = scratch_path(spark, "edges")
    edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().write.parquet(path)
    state = None
    while True:
        now = spark.read.schema(schema).parquet(path)
        new = scratch_path(spark, "edges")
        _round(now).write.parquet(new)
        after = spark.read.schema(schema).parquet(new).agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        remove(spark, path)
        path = new
        if tuple(after) == state:
            break
        state = tuple(after)
    stars = spark.read.schema(schema).parquet(path)
    roots = stars.select("u").distinct().select(F.col("u").alias("node"), F.col("u").alias("root"))
    return stars.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots)
