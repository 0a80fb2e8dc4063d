"""SimHash near-duplicates by an inverted index over the byte positions of 64-bit fingerprints.

Two fingerprints of at most four different bits agree in at least four of their eight bytes. Posting
lists of single bytes would pair a 256th of all fingerprints, so the index keeps lists of three
(position, byte) entries at once: ``triples`` names the fewest sets of three positions such that any
four agreeing positions hold one of them (20 sets: Turan's construction for three blocks of
positions). Within a list the agreeing bytes of each pair are tallied, pairs below the guaranteed
minimum are dropped and the rest is verified by its differing bits.

Scale: equal fingerprints collapse first, so a group of exact copies is one entry. Lists of one entry
go, lists of two are their own pair, lists of a ``FEW`` are compared inside one row. A longer list is
cut into blocks of about ``BLOCK`` entries and every pair of blocks is a group of its own, so no task
holds more than two blocks, and a group gives back a spanning forest of its links instead of all pairs.
Nothing is capped.

Rules: a text without words, or null, has fingerprint zero and links like any other. Rows that repeat
get the same class. A null id never is the name of a class with an id in it.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volumetry.llm.batches import add_columns, unused
from volumetry.llm.graph import components
from volumetry.session import cut_lineage

SEED = 42
WORDS = 4
BITS = 4  # fingerprints link at this many differing bits or fewer
BYTES = 8
LEAST = BYTES - BITS  # bytes that a linked pair shares at least
FEW = 16  # entries of a posting list that are compared inside one row
BLOCK = 2048  # entries of a posting list that one group takes from either side
CHUNK = 1 << 16  # shingles whose bits are held unpacked at once


def triples() -> list[tuple[int, int, int]]:
    """Sets of three byte positions, one of which is in any set of four."""
    blocks = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [c for b in blocks for c in combinations(b, 3)]
    for b, after in zip(blocks, [*blocks[1:], blocks[0]]):
        out += [(*c, x) for c in combinations(b, 2) for x in after]
    return out


def fingerprint(data: bytes | None, words: int = WORDS) -> int:
    """The signed 64-bit fingerprint of one text in UTF-8."""
    tokens = (data or b"").lower().split()  # both know ASCII letters and white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), "int64", len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(tokens) - words + 1)
    last = min(words, len(tokens)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[last:].tolist())], "<u8")
    counts = np.zeros(64, "int64")
    for at in range(0, n, CHUNK):
        part = hashes[at:at + CHUNK].view("u1").reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0].astype("int64"))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", keep: list[str] | None = None,
                 words: int = WORDS) -> DataFrame:
    """Adds the fingerprint of every whole text."""
    def run(texts: list) -> list[pa.Array]:
        return [pa.array([fingerprint(t, words) for t in texts], pa.int64())]

    return add_columns(df, text, [T.StructField(out, T.LongType())], run, keep, binary=True)


def entries(fps: DataFrame, sets: Sequence[tuple[int, ...]]) -> DataFrame:
    """Posting-list entries ``(at, fp)`` of distinct fingerprints; ``at`` holds the number of the set of
    positions above its bytes."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255)
    place = lambda s: sum((byte(p) * (256 ** k) for k, p in enumerate(s)), F.lit(0))
    keys = [F.lit(i * 256 ** len(s)) + place(s) for i, s in enumerate(sets)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("at"))


def linked(a: Column, b: Column) -> Column:
    """The tally of shared bytes reaches the guaranteed minimum, and the differing bits are few enough."""
    differing = a.bitwiseXOR(b)
    same = sum((F.shiftrightunsigned(differing, 8 * p).bitwiseAND(255) == 0).cast("int") for p in range(BYTES))
    return (same >= LEAST) & (F.bit_count(differing) <= BITS)


def forest(group: pd.DataFrame) -> pd.DataFrame:
    """Links of one group as a spanning forest. Each entry is tallied against all later ones at once:
    shared bytes first, then the differing bits of what is left."""
    fps = np.unique(group["fp"].to_numpy("int64"))
    data = fps.view("u1").reshape(-1, BYTES)
    part = np.arange(len(fps))
    out = []
    for i in range(len(fps) - 1):
        shared = (data[i + 1:] == data[i]).sum(axis=1)
        near = i + 1 + np.flatnonzero(shared >= LEAST)
        near = near[np.bitwise_count((fps[near] ^ fps[i]).view("u8")) <= BITS]
        parts, first = np.unique(part[near], return_index=True)
        for other, j in zip(parts.tolist(), near[first].tolist()):
            if other != part[i]:
                out.append((fps[i], fps[j]))
                part[part == other] = part[i]
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def links(fps: DataFrame, positions: int = 3) -> DataFrame:
    """Links ``(u, v)`` that connect all linked fingerprints of a table of distinct ``fp``. Lists of
    three positions are short up to about a billion fingerprints; take four beyond."""
    sets = triples() if positions == 3 else list(combinations(range(BYTES), 4))
    listed = entries(fps, sets)
    counts = listed.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
    counts = cut_lineage(counts.where("n > 1"), "lists")
    twos = counts.where("n = 2").select("u", "v").where(linked(F.col("u"), F.col("v")))

    some = listed.join(counts.where(f"n between 3 and {FEW}").select("at"), "at")
    some = some.groupBy("at").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    later = lambda x, i: F.filter(F.slice("fps", i + 2, FEW), lambda y: linked(x, y))
    ties = F.flatten(F.transform("fps", lambda x, i: F.transform(later(x, i), lambda y: F.struct(x.alias("u"), y.alias("v")))))
    few = some.select(F.explode(ties).alias("l")).select("l.u", "l.v")

    long = counts.where(f"n > {FEW}").select("at", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    cut = listed.join(long, "at").withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cells = cut.select("at", "fp", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    cells = cells.select("at", "fp", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    many = cells.groupBy("at", "i", "j").applyInPandas(forest, "u long, v long")
    return twos.union(few).union(many).distinct()


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, positions: int = 3) -> DataFrame:
    """One row per row of ``df``: id, ``fp`` and ``component_id``, the smallest id in its class."""
    made = fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp", ["doc_id"], words)
    made = cut_lineage(made, "fingerprints")
    firsts = made.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = cut_lineage(components(links(firsts.select("fp"), positions)), "classes").withColumnsRenamed({"node": "fp"})
    named = firsts.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return made.join(named, "fp", "left").select(F.col("doc_id").alias(doc_id), "fp", "component_id")


def one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class: the smallest id, and of several rows with it the
    one with the smallest hash of its text. Columns and their order stay. A class without any id keeps a
    row with null id."""
    mark = unused(docs, "mark")
    named = docs.withColumn(mark, F.coalesce(F.xxhash64(text), F.lit(0)))
    made = fingerprints(named.select(F.col(doc_id).alias("_id"), F.col(mark).alias("_mark"), F.col(text).alias("_text")), "_text", "fp", ["_id", "_mark"])
    made = cut_lineage(made, "fingerprints")
    firsts = made.groupBy("fp").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_mark").alias("mark"))).alias("first"))
    found = cut_lineage(components(links(firsts.select("fp"))), "classes").withColumnsRenamed({"node": "fp"})
    classed = firsts.join(found, "fp", "left").select("first", F.coalesce("root", "fp").alias("root"))
    chosen = classed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("_id"), F.col("first.mark").alias("_of"))
    kept = named.join(chosen, named[doc_id].eqNullSafe(chosen["_id"]) & (named[mark] == chosen["_of"]), "left_semi")
    # the same id and text may be there several times
    return kept.dropDuplicates([doc_id, mark]).select(docs.columns)
