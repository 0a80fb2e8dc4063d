"""The best documents for each of a set of queries, from posting lists in blocks of similar documents.

A document's score is the sum over the terms of a query of a weight by rarity times a saturated share of
the term in the document, in integers (``search`` gives the formula). Each posting list is clustered: a
document's weighted term vector lies on one side or the other of random planes through the origin, and the
sides of the first few planes, more for a longer list, name its block, about ``BLOCK`` documents each. A block
keeps the greatest value of each term in any of its documents. For a query this summary bounds every score
in the block, and a block is skipped only if the bound is below the query's threshold.

The threshold is the k-th best exact score among the documents of the query's rarest terms. Lists of the
commonest terms, whose greatest values together stay below it, need no blocks: a document in no other list
cannot reach the threshold. Documents of the blocks left are scored exactly, so the result is exact.

Scale: queries are taken in blocks of at most ``TERMS`` terms, whose words, weights and term pairs are all
that tasks are sent. Documents are tokenised once into their terms of the queries' vocabulary; every row of
the table is counted and indexed. Summaries are combined within a task before they are shuffled, so a block
that holds a third of all documents (copies) is one row of a summary a task. Blocks that are left meet their
postings in a join on list and block; scores and ranks are cut to k a query in each task before they move.

Rules: terms are maximal runs of ASCII digits and letters and of all other characters from U+0080 on, with
A-Z lowered. Null and empty texts have no terms. Rows that repeat are documents of their own and take a rank
each; a document with null id is ranked behind equal scores. A query without a term or without a hit has no
row, queries that repeat get theirs each. Other columns are not read, so none clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volumetry.llm.batches import pieces
from volumetry.session import cut_lineage

BLOCK = 32  # documents of a block, on average
PLANES = 24  # at most 2^24 blocks a list
SEED = 42
TERMS = 10_000  # term occurrences of the queries that are worked on together
QUERIES = 400  # and at most so many queries
SEEDS = 8  # times k, the postings of a query's rarest terms that give its threshold
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8."""
    return (text or b"").translate(TERM_BYTES).split()


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64())


def _lists(starts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype("int32")), pa.array(values.astype("int32")))


def vectors(docs: DataFrame, words: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its number, id, terms ``n`` in all, and numbers and counts of those in ``words``."""
    source = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("row", T.LongType()), source.schema["doc"], T.StructField("n", T.LongType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        number = {w: i for i, w in enumerate(sent.value)}
        size = max(1, len(number))
        for batch in batches:
            for piece in pieces(batch, "text"):
                split = [terms(t) for t in piece.column(1).cast(pa.binary()).to_pylist()]
                n = np.array([len(s) for s in split], "int64")
                found = np.fromiter((number.get(w, -1) for s in split for w in s), "int64", int(n.sum()))
                owner = np.repeat(np.arange(len(split)), n)
                key, tf = np.unique((owner * size + found)[found >= 0], return_counts=True)
                starts = np.searchsorted(key // size, np.arange(len(split) + 1))
                yield pa.RecordBatch.from_arrays([_ints(row + np.arange(len(split))), piece.column(0), _ints(n), _lists(starts, key % size), _lists(starts, tf)],
                                                 names=schema.names)
                row += len(split)

    return source.mapInArrow(run, schema)


def weighed(found: DataFrame, documents: int, length: int, weights: np.ndarray) -> DataFrame:
    """Terms with their saturated shares ``part`` in each document, and the sides of the planes it lies on."""
    schema = T.StructType([T.StructField("row", T.LongType()), found.schema["doc"], T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("part", T.ArrayType(T.IntegerType())), T.StructField("sides", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(SEED).choice(np.array([-1, 1], "f4"), (max(1, len(weights)), PLANES)) * weights[:, None].astype("f4")
        for batch in batches:
            n = np.asarray(batch.column(2))
            at = np.asarray(batch.column(3).offsets).astype("int64")
            ids = np.asarray(batch.column(3).values)[at[0]:at[-1]]
            tf = np.asarray(batch.column(4).flatten()).astype("int64")
            at = at - at[0]
            m = 25 + 75 * n * documents // max(1, length)
            part = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(at)))
            sides = np.zeros(len(n), "int32")
            some = np.flatnonzero(np.diff(at))
            step = max(1, len(some) // max(1, len(ids) // (1 << 18) + 1))
            for k in range(0, len(some), step):
                these = some[k:k + step]
                low, high = at[these[0]], at[these[-1] + 1]
                votes = np.add.reduceat(planes[ids[low:high]] * part[low:high, None].astype("f4"), at[these] - low, axis=0)
                sides[these] = (votes > 0) @ (1 << np.arange(PLANES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(at, ids), _lists(at, part), pa.array(sides, pa.int32())], names=schema.names)

    return found.mapInArrow(run, schema)


class Queries:
    """A block of queries: vocabulary, a matrix of term counts times weights, and the terms of each."""

    def __init__(self, texts: Iterable[bytes | None]):
        counted = [Counter(terms(t)) for t in texts]
        self.words = sorted({w for c in counted for w in c})
        number = {w: i for i, w in enumerate(self.words)}
        self.terms = [np.array([number[w] for w in sorted(c)], "int64") for c in counted]
        self.counts = [np.array([c[w] for w in sorted(c)], "int64") for c in counted]

    def weigh(self, df: np.ndarray, documents: int) -> None:
        self.df = df
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], "int64")
        self.gain = np.zeros((len(self.words), len(self.terms)), "int64")
        for q, (t, c) in enumerate(zip(self.terms, self.counts)):
            self.gain[t, q] = c * self.weights[t]

    def rarest(self, least: int) -> list[np.ndarray]:
        """Each query's rarest terms, so many that their lists hold ``least`` postings (or all there are)."""
        out = []
        for t in self.terms:
            t = t[self.df[t] > 0]
            t = t[np.argsort(self.df[t], kind="stable")]
            out.append(t[:np.searchsorted(np.cumsum(self.df[t]), least) + 1])
        return out

    def needed(self, best: np.ndarray, floor: np.ndarray) -> list[np.ndarray]:
        """Each query's terms without the commonest ones whose greatest gains together stay below its floor."""
        out = []
        for q, t in enumerate(self.terms):
            t = t[self.df[t] > 0]
            t = t[np.argsort(-self.df[t], kind="stable")]
            reach = np.cumsum(self.gain[t, q] * best[t])
            out.append(t[np.searchsorted(reach, floor[q], "left"):])
        return out


def scored(docs: DataFrame, gain: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
    """``(query, row, doc, score)`` of pairs of a document and a query with a score above zero: the queries
    in the column ``queries``, or those of which the document has a term in ``wanted`` (terms x queries)."""
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("row", T.LongType()), docs.schema["doc"], T.StructField("score", T.LongType())])
    sent = docs.sparkSession.sparkContext.broadcast((gain, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, wanted = sent.value
        for batch in batches:
            ids = [np.asarray(a.values) for a in batch.column(2)]
            part = [np.asarray(a.values).astype("int64") for a in batch.column(3)]
            asked = None if wanted is not None else [np.asarray(a.values) for a in batch.column(4)]
            query, owner, score = [], [], []
            for d in range(batch.num_rows):
                qs = np.flatnonzero(wanted[ids[d]].any(axis=0)) if asked is None else asked[d]
                if len(qs):
                    s = part[d] @ gain[ids[d][:, None], qs]
                    query.append(qs[s > 0])
                    score.append(s[s > 0])
                    owner.append(np.full(int((s > 0).sum()), d))
            if query:
                at = np.concatenate(owner)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query), pa.int32()), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)),
                                                  _ints(np.concatenate(score))], names=schema.names)

    return docs.mapInArrow(run, schema)


def best_of(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with their rank; equal scores by id, null ids last."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last(), "row")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def summaries(docs: DataFrame, masks: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Blocks ``(term, cell, other, part)`` of the lists with a mask (-1: none): the greatest part of each
    other term that goes with the list, in any document of the block. ``pairs`` has the others of each list
    as offsets and values."""
    sent = docs.sparkSession.sparkContext.broadcast((masks, *pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, offsets, others = sent.value
        size = len(masks)
        joint = np.repeat(np.arange(size), np.diff(offsets)) * size + others  # sorted
        for batch in batches:
            at = np.asarray(batch.column(0).offsets).astype("int64")
            ids = np.asarray(batch.column(0).flatten()).astype("int64")
            part = np.asarray(batch.column(1).flatten()).astype("int64")
            sides, at = np.asarray(batch.column(2)).astype("int64"), at - at[0]
            owner = np.repeat(np.arange(len(sides)), np.diff(at))
            lists = np.flatnonzero(masks[ids] >= 0)
            fan = np.diff(at)[owner[lists]]
            ends = np.cumsum(fan)
            for low in range(0, len(lists), PAIRED):
                some = slice(low, low + PAIRED)
                f = fan[some]
                left = np.repeat(lists[some], f)
                base = ends[some] - f
                right = np.repeat(at[owner[lists[some]]], f) + np.arange(len(left)) - np.repeat(base - (base[0] if len(base) else 0), f)
                key = ids[left] * size + ids[right]
                place = np.minimum(np.searchsorted(joint, key), len(joint) - 1)
                ok = joint[place] == key
                left, right, place = left[ok], right[ok], place[ok]
                cell = sides[owner[left]] & masks[ids[left]]
                order = np.lexsort((cell, place))
                p, c = place[order], cell[order]
                first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (c[1:] != c[:-1])])) if len(p) else np.zeros(0, "int64")
                top = np.maximum.reduceat(part[right][order], first) if len(first) else np.zeros(0, "int64")
                p, c = p[first], c[first]
                yield pa.RecordBatch.from_arrays([pa.array(joint[p] // size, pa.int32()), pa.array(c, pa.int32()), pa.array(others[p], pa.int32()), pa.array(top, pa.int32())],
                                                 names=["term", "cell", "other", "part"])

    made = docs.select("ids", "part", "sides").mapInArrow(run, "term int, cell int, other int, part int")
    return made.groupBy("term", "cell", "other").agg(F.max("part").alias("part"))


PAIRED = 1 << 14  # postings whose documents are laid out at once


def _block(docs: DataFrame, asked: list, k: int, doc_id: str, text: str, item: T.DataType) -> DataFrame:
    """Ranked documents of one block of queries ``(id, text)``."""
    spark = docs.sparkSession
    use = Queries(t for _, t in asked)
    found = cut_lineage(vectors(docs, use.words, doc_id, text), "vectors")
    documents, length = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = found.select(F.explode("ids").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()  # the vocabulary at most
    df = np.zeros(len(use.words), "int64")
    for r in counts:
        df[r.term] = r.df
    use.weigh(df, documents)
    docs = cut_lineage(weighed(found, documents, length, use.weights), "weighed")

    wanted = np.zeros(use.gain.shape, bool)
    for q, t in enumerate(use.rarest(SEEDS * k)):
        wanted[t, q] = True
    seeds = best_of(scored(docs.select("row", "doc", "ids", "part"), use.gain, wanted), k)
    floor = np.zeros(len(asked), "int64")
    for r in seeds.where(F.col("rank") == k).collect():  # one row a query
        floor[r["query"]] = r.score
    best = np.zeros(len(use.words), "int64")
    pair = F.explode(F.arrays_zip("ids", "part")).alias("p")
    for r in docs.select(pair).groupBy("p.ids").agg(F.max("p.part").alias("best")).collect():  # the vocabulary at most
        best[r.ids] = r.best

    needed = use.needed(best, floor)
    goes = [(int(t), int(u)) for q, ts in enumerate(needed) for t in ts for u in use.terms[q]]
    joint = np.unique(np.array(goes, "int64").reshape(-1, 2), axis=0)
    offsets = np.searchsorted(joint[:, 0], np.arange(len(use.words) + 1))
    masks = np.full(len(use.words), -1, "int64")
    for t in np.unique(joint[:, 0]).tolist():
        masks[t] = (1 << min(PLANES, max(0, math.ceil(math.log2(df[t] / BLOCK))))) - 1
    blocks = summaries(docs, masks, (offsets, joint[:, 1]))

    gains = [(q, int(t), int(u), int(use.gain[u, q])) for q, ts in enumerate(needed) for t in ts for u in use.terms[q]]
    gains = spark.createDataFrame(gains, "query int, term int, other int, gain long")
    floors = spark.createDataFrame([(q, int(f)) for q, f in enumerate(floor)], "query int, floor long")
    bounds = blocks.join(F.broadcast(gains), ["term", "other"]).groupBy("query", "term", "cell").agg(F.sum(F.col("gain") * F.col("part")).alias("bound"))
    left = bounds.join(F.broadcast(floors), "query").where(F.col("bound") >= F.col("floor")).select("query", "term", "cell")
    left = cut_lineage(left.groupBy("term", "cell").agg(F.sort_array(F.collect_list("query")).alias("queries")), "blocks")

    mask = spark.createDataFrame([(int(t), int(masks[t])) for t in np.flatnonzero(masks >= 0)], "term int, mask int")
    postings = docs.select("row", "sides", F.explode("ids").alias("term")).join(F.broadcast(mask), "term")
    postings = postings.select("row", "term", F.col("sides").bitwiseAND(F.col("mask")).alias("cell"))
    chosen = postings.join(left, ["term", "cell"]).select("row", F.explode("queries").alias("query")).distinct()
    chosen = chosen.groupBy("row").agg(F.collect_list("query").alias("queries"))
    final = scored(docs.select("row", "doc", "ids", "part").join(chosen, "row").select("row", "doc", "ids", "part", "queries"), use.gain)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(asked)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", item)]))
    out = best_of(final, k).join(F.broadcast(names), "query")
    return out.select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``, the k best documents of each query with a score above zero.

    With N documents that have a term, L terms in all, n terms in a document, a term in df documents and tf
    times in this one: w = floor(1000 ln((2N + 2) / (2df + 1))), m = 25 + 75nN div L, and the score sums
    w ((10^9 tf) div (1000 tf + 8m)) over the query's terms, repeats included."""
    kind = queries.schema[item_id].dataType
    held, size, out = [], 0, None

    def add() -> None:
        nonlocal held, size, out
        made = cut_lineage(_block(docs, held, k, doc_id, text, kind), "ranked")
        out, held, size = made if out is None else out.unionByName(made), [], 0

    for row in queries.select(item_id, F.col(query).cast("binary")).toLocalIterator():
        value = None if row[1] is None else bytes(row[1])
        held.append((row[0], value))
        size += len(terms(value))
        if size >= TERMS or len(held) >= QUERIES:
            add()
    if held or out is None:
        add()
    return out
