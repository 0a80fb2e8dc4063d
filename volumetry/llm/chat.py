"""Chat formatting over reply trees, in DataFrame functions.

A tree has nodes with a parent. Root-to-leaf paths come from iterative self-joins with doubling: after k
rounds every leaf has met its ancestors up to ``2**k - 1`` steps away and every node knows its ancestor
``2**k`` steps up, so a path of n nodes takes about log2(n) rounds and no arrays grow on the way. Paths
are ranked by the mean score of their nodes; each chosen one becomes one conversation.

Template: ``<|role|>``, new line, text, ``<|end|>``, new line per turn. A backslash goes before each
backslash, bar and > of a role or text, so no text can hold a control string, and taking the backslashes
away again gives the text back. The loss mask is a list of spans of the output, one per assistant turn.

Rules: null text and role are empty. A null tree id is a key like any other. A node whose parent is
missing is a root. Nodes on a cycle lead to no root and are left out. Equal scores go by the name of the
leaf. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from volumetry.session import cut_lineage, remove, scratch_path

END = "<|end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\|>])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(nodes: DataFrame) -> DataFrame:
    """``(tree, leaf, node, up)`` for every leaf and each node on its way to the root, ``up`` steps away,
    from ``(tree, node, parent)``; nodes are unique in their tree and keys are not null."""
    spark = nodes.sparkSession
    nodes = cut_lineage(nodes.select("tree", "node", "parent"), "nodes")
    there = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    jumps = nodes.join(there, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("above"))
    parents = nodes.select("tree", F.col("parent").alias("node"))
    way = nodes.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up"))
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    made = []
    for k in range(int(largest).bit_length()):
        ahead = []
        for df in (way, jumps):
            ahead.append(scratch_path(spark, "paths"))
            df.write.parquet(ahead[-1])
        for path in made:
            remove(spark, path)
        made = ahead
        way, jumps = spark.read.parquet(ahead[0]), spark.read.parquet(ahead[1])
        known = jumps.where("above is not null")
        more = way.join(known, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        second = known.select("tree", F.col("node").alias("above"), F.col("above").alias("next"))
        # a node whose ancestor that far up is missing takes no part in later rounds
        jumps = known.join(second, ["tree", "above"]).select("tree", "node", F.col("next").alias("above"))
        way = way.union(more)
    return way


def conversations(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """Formats reply trees given as ``tree, node, parent, role, text, score``: one row per chosen path with
    ``tree, leaf, rank, n_turns, formatted, loss_spans``. ``best`` keeps that many paths of each tree;
    all by default."""
    key = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit(""))
    rows = nodes.select("tree", key.alias("_tree"), "node", "parent", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    way = paths(rows.select(F.col("_tree").alias("tree"), "node", "parent")).withColumnRenamed("tree", "_tree")
    placed = way.join(rows.drop("parent"), ["_tree", "node"])
    turns = placed.groupBy("_tree", "leaf").agg(
        F.first("tree").alias("tree"), F.avg("score").alias("score"),
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    order = Window.partitionBy("_tree").orderBy(F.desc("score"), "leaf")
    turns = turns.withColumn("rank", F.row_number().over(order))
    if best is not None:
        turns = turns.where(F.col("rank") <= best)
    head = lambda t: F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>\n"))
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(head(t), escape(t["text"]), F.lit(END)).alias("shown"), F.char_length(head(t)).alias("before"),
        F.char_length(escape(t["text"])).alias("length"), (t["role"] == "assistant").alias("loss")))
    turns = turns.withColumn("_parts", parts)
    spans = F.aggregate(
        "_parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.char_length(p["shown"])).alias("at"),
            F.when(p["loss"], F.concat(s["spans"], F.array(F.struct(
                (s["at"] + p["before"]).alias("start"), (s["at"] + p["before"] + p["length"]).alias("end")))))
            .otherwise(s["spans"]).alias("spans")))
    return turns.select("tree", "leaf", "rank", F.size("turns").alias("n_turns"),
                        F.array_join(F.col("_parts.shown"), "").alias("formatted"), spans["spans"].alias("loss_spans"))


def chain(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A plain table of turns as trees of one branch: each row follows the one before it. Rows of one turn
    go by role and text."""
    order = Window.partitionBy(tree).orderBy(turn, "role", "text")
    placed = rows.select(F.col(tree).alias("tree"), F.row_number().over(order).alias("node"), "role", "text")
    return placed.select("tree", "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: Column) -> Column:
    """The turns of an output, as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")
    cut = F.lit("|>\n")

    def turn(p: Column) -> Column:
        at = F.instr(p, cut)  # a role's own > has a backslash before it, so the first end is the right one
        return F.struct(unescape(F.substring(p, F.lit(3), at - 3)).alias("role"), unescape(F.substring(p, at + 3, F.char_length(p))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")

