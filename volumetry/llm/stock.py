"""Packing documents into sequences of one length as a cutting-stock problem, by column generation.

A document longer than a sequence gives whole sequences and a rest. The rests are counted by length; their
lengths in units of ``UNIT`` tokens, rounded up, are the widths of a cutting-stock problem. Its linear
program starts from patterns of one width each; a knapsack by dynamic programming over the sequence prices
new patterns with the dual values until the bound z / best price is within ``GAP`` of z. Rounding takes the
whole part of each pattern; what is left of the demand is cut by bounded knapsacks, each used as often as
the demand allows. Patterns go by falling fill. Documents are ranked by length within their width, and
rank r of a width is in the pattern, sequence and place that its number says.

Rounding up leaves gaps, of half a unit a document on average. With T tokens in the rests, the first
T // length sequences are kept; the documents of the others, the worst filled, are cut along the gaps of
the kept ones, which hold all of them but T % length tokens. These are cut into sequences of powers of two.
So nothing is padded, and only the few documents of the last patterns (and those over a sequence) are cut.

Scale: the driver holds counts of at most ``length`` lengths and the patterns (at most twice as many as
widths). Documents are numbered within a task and a length while the ids are written, so ranks need a sum
over tasks and no sort. Gaps and the documents that fill them are intervals on one line, joined on cells of
that line. Only rows of a few numbers take part; ids move once, to the pieces of their document. No step
gathers a width, so very many documents of one length are no hot group.

Rules: documents without ids (null or empty) have no piece; repeated rows are packed each; any type of id
passes through, null too. An empty table gives an empty table. Result columns are new, so no input column
clashes with them. Which of the documents of one length is where depends on the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volumetry.llm import wordbatch
from volumetry.llm.batches import pieces as pieces_of
from volumetry.llm.bpe import send
from volumetry.session import cut_lineage

LENGTH = 4096
UNIT = 8
GAP = 0.0005  # of the number of sequences, between the linear program and its bound
ROUNDS = 8  # times the number of widths, prices at most; the patterns so far are packed then
CELL = 512  # tokens of the line of gaps that one join key stands for
TEXTS = 4 << 20  # bytes of text that are encoded at once, or one longer text
RUN = 4096  # sequences whose gaps are added up before the sums are


def priced(size: int, widths: np.ndarray, values: np.ndarray) -> tuple[float, np.ndarray]:
    """The most valuable multiset of widths of at most ``size`` in all: value and copies of each."""
    use = np.flatnonzero(values > 1e-12)
    w, v = widths[use], values[use]
    best, taken = np.zeros(size + 1), np.full(size + 1, -1)
    fits = np.searchsorted(w, np.arange(size + 1), "right")  # widths go up
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        if fits[c]:
            with_ = best[c - w[:fits[c]]] + v[:fits[c]]
            k = int(with_.argmax())
            if with_[k] > best[c] + 1e-12:
                best[c], taken[c] = with_[k], k
    copies, c = np.zeros(len(widths), "int64"), size
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            copies[use[taken[c]]] += 1
            c -= int(w[taken[c]])
    return float(best[size]), copies


def relaxed(size: int, widths: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row) and how often the linear program uses each, by the revised simplex method."""
    m = len(widths)
    patterns = np.diag(size // widths).astype("int64")
    inverse = np.diag(1 / np.diag(patterns).astype("float64"))
    uses = inverse @ demand
    for _ in range(ROUNDS * m):
        prices = inverse.sum(axis=0)
        value, column = priced(size, widths, prices)
        total = uses.sum()
        if value <= 1 + 1e-9 or total - total / value <= GAP * total:
            break
        direction = inverse @ column
        ratio = np.full(m, np.inf)
        up = direction > 1e-9
        ratio[up] = uses[up] / direction[up]
        out = int(ratio.argmin())
        step = ratio[out]
        if not np.isfinite(step):
            break
        uses = np.maximum(uses - step * direction, 0)
        uses[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        patterns[out] = column
    return patterns, uses


def fullest(size: int, widths: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Copies of each width, no more than are left, that fill ``size`` best; wide ones first among equals."""
    kinds, parts = [], []
    for k in np.flatnonzero(left):
        n, part = int(min(left[k], size // widths[k])), 1
        while n:
            part = min(part, n)
            kinds.append(int(k))
            parts.append(part)
            n, part = n - part, 2 * part
    best = np.full(size + 1, -np.inf)
    best[0] = 0
    took = np.zeros((len(kinds), size + 1), bool)
    for i, (k, part) in enumerate(zip(kinds, parts)):
        w = int(widths[k]) * part
        with_ = best[:size + 1 - w] + w + part * (widths[k] / size) ** 2 / size
        better = with_ > best[w:]
        took[i, w:] = better
        best[w:][better] = with_[better]
    c, copies = int(best.argmax()), np.zeros(len(widths), "int64")
    for i in range(len(kinds) - 1, -1, -1):
        if took[i, c]:
            copies[kinds[i]] += parts[i]
            c -= int(widths[kinds[i]]) * parts[i]
    return copies


def cutting(size: int, widths: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and whole uses that together meet a demand exactly, by falling fill."""
    patterns, uses = relaxed(size, widths, demand.astype("float64"))
    often = np.floor(uses + 1e-7).astype("int64")
    left = demand - often @ patterns
    # never more than asked for, should a use have been rounded up
    while (left < 0).any():
        k = int(np.flatnonzero(left < 0)[0])
        often[np.flatnonzero((patterns[:, k] > 0) & (often > 0))[0]] -= 1
        left = demand - often @ patterns
    rows, counts = [patterns[often > 0]], [often[often > 0]]
    while left.any():
        pattern = fullest(size, widths, left)
        held = pattern > 0
        n = int((left[held] // pattern[held]).min())
        rows.append(pattern[None])
        counts.append(np.array([n]))
        left = left - n * pattern
    rows, counts = np.concatenate(rows), np.concatenate(counts)
    order = np.argsort(-(rows @ widths), kind="stable")
    return rows[order], counts[order]


@dataclass
class Plan:
    """Where the ranks of each width go: ``key`` (width, first rank) in order, with the first sequence, the
    place within it and the copies a sequence; per length the documents and tokens before it in its width."""

    unit: int
    key: np.ndarray
    sequence: np.ndarray
    place: np.ndarray
    copies: np.ndarray
    before: np.ndarray
    tokens: np.ndarray
    kept: int  # sequences whose gaps are filled
    line: np.ndarray  # per width, what turns tokens of its ranks into a place on the line of gaps
    left: int  # tokens behind the last gap


HIGH = 1 << 40  # ranks of a width


def planned(counts: dict[int, int], length: int, unit: int = UNIT) -> Plan:
    """The plan for counts of documents by their length in tokens (under ``length``)."""
    sizes = np.array(sorted(counts), "int64")
    many = np.array([counts[s] for s in sizes.tolist()], "int64")
    width = -(-sizes // unit)
    widths, first, group = np.unique(width, return_index=True, return_inverse=True)
    demand = np.bincount(group, many, len(widths)).astype("int64") if len(sizes) else np.zeros(0, "int64")
    total = int((sizes * many).sum())
    kept = total // length
    rows, uses = cutting(length // unit, widths, demand) if len(sizes) else (np.zeros((0, 0), "int64"), np.zeros(0, "int64"))
    start = np.concatenate([[0], np.cumsum(uses)])
    entries = []
    used = np.zeros(len(widths), "int64")
    limit = demand.copy()  # ranks from here on are cut along the gaps
    for p in range(len(rows)):
        place = 0
        for k in np.flatnonzero(rows[p]).tolist():
            a = int(rows[p, k])
            entries.append((int(widths[k]) * HIGH + int(used[k]), int(start[p]), place, a))
            if start[p + 1] > kept:
                limit[k] = min(limit[k], used[k] + max(0, kept - int(start[p])) * a)
            used[k] += int(uses[p]) * a
            place += a
    entries.sort()
    key, sequence, place, copies = (np.array([e[i] for e in entries], "int64") for i in range(4))
    # documents and tokens of shorter lengths of the same width
    before, tokens = np.zeros(length + 1, "int64"), np.zeros(length + 1, "int64")
    line = np.zeros(length // unit + 2, "int64")
    at = 0
    for k in range(len(widths)):
        n = t = 0
        below = None  # tokens of the ranks under the limit
        for i in range(int(first[k]), int(first[k + 1]) if k + 1 < len(first) else len(sizes)):
            before[sizes[i]], tokens[sizes[i]] = n, t
            if below is None and limit[k] <= n + many[i]:
                below = t + int(limit[k] - n) * int(sizes[i])
            n, t = n + int(many[i]), t + int(many[i] * sizes[i])
        line[widths[k]] = at - below
        at += t - below
    return Plan(unit, key, sequence, place, copies, before, tokens, kept, line, total - kept * length)


class Numbers:
    """Numbers the documents of one task: row, tokens, first whole sequence, rest and its number among rests
    of its length. Ids go on as bytes; documents without any are left out."""

    names = ("part", "row", "tokens", "whole", "rest", "nth")

    def __init__(self, length: int):
        self.length, self.part, self.row, self.whole = length, TaskContext.get().partitionId(), 0, 0
        self.seen = np.zeros(length, "int64")

    def batch(self, docs: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        n = np.array(list(map(len, ids)), "int64") // 4
        some = np.flatnonzero(n)
        n = n[some]
        rest = n % self.length
        order = np.argsort(rest, kind="stable")
        value, start, many = np.unique(rest[order], return_index=True, return_counts=True)
        nth = np.empty(len(rest), "int64")
        nth[order] = np.arange(len(rest)) - np.repeat(start, many) + np.repeat(self.seen[value], many)
        self.seen[value] += many
        blocks = n // self.length
        firsts = self.whole + np.cumsum(blocks) - blocks
        cols = [np.full(len(n), self.part), self.row + np.arange(len(n)), n, firsts, rest, nth]
        self.row, self.whole = self.row + len(n), self.whole + int(blocks.sum())
        made = pa.array([ids[k] for k in some.tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), docs.take(pa.array(some)), made], names=[*self.names, "doc", "ids"])

    @classmethod
    def schema(cls, doc: T.DataType) -> T.StructType:
        return T.StructType([*(T.StructField(n, T.LongType()) for n in cls.names), T.StructField("doc", doc), T.StructField("ids", T.BinaryType())])


def encoded(df: DataFrame, path: str, end: int | None = None, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Numbered documents with the ids of every whole text (null: empty) and ``end`` behind them."""
    sent = send(df, path)
    tail = b"" if end is None else np.array([end], "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, vocabulary = Numbers(length), wordbatch.load(sent.value)
        for batch in batches:
            for piece in pieces_of(batch, "text", TEXTS):
                yield number.batch(piece.column(0), [ids + tail for ids in vocabulary.encode_all(piece.column(1).to_pylist())])

    source = df.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    return source.mapInArrow(run, Numbers.schema(source.schema["doc"].dataType))


def numbered(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", length: int = LENGTH) -> DataFrame:
    """Numbered documents from a column of id lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers(length)
        for batch in batches:
            column = batch.column(1)
            at, flat = np.asarray(column.offsets).tolist(), np.asarray(column.values).astype("<i4")
            known = column.is_valid().to_pylist()
            yield number.batch(batch.column(0), [flat[a:b].tobytes() if ok else b"" for a, b, ok in zip(at, at[1:], known)])

    source = df.select(F.col(doc_id).alias("doc"), F.col(ids).cast("array<int>").alias("ids"))
    return source.mapInArrow(run, Numbers.schema(source.schema["doc"].dataType))


def placed(rests: DataFrame, plan: Plan) -> DataFrame:
    """Sequence and place of each rest with its ``rank`` among all of its length; those that are cut have
    their start on the line of gaps instead."""
    schema = "part long, row long, start long, rest long, seq long, place long, line long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, row, start, rest, rank = (np.asarray(batch.column(c)).astype("int64") for c in ("part", "row", "start", "rest", "rank"))
            width = -(-rest // plan.unit)
            ranked = plan.before[rest] + rank
            at = np.searchsorted(plan.key, width * HIGH + ranked, "right") - 1
            copies, behind = plan.copies[at], ranked - plan.key[at] % HIGH
            seq, place = plan.sequence[at] + behind // copies, plan.place[at] + behind % copies
            line = plan.tokens[rest] + rank * rest + plan.line[width]
            cut = seq >= plan.kept
            cols = [pa.array(c) for c in (part, row, start, rest)]
            cols += [pa.array(seq, mask=cut), pa.array(place, mask=cut), pa.array(line, mask=~cut)]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "row", "start", "rest", "seq", "place", "line"])

    return rests.mapInArrow(run, schema)


def on_line(intervals: DataFrame) -> DataFrame:
    """One row for each cell of the line that an interval ``[low, high)`` touches."""
    cell = F.sequence(F.floor(F.col("low") / CELL), F.floor((F.col("high") - 1) / CELL))
    return intervals.select("*", F.explode(cell).alias("cell"))


def filled(cut: DataFrame, kept: DataFrame, plan: Plan, length: int) -> DataFrame:
    """Pieces of the cut rests in the gaps of kept sequences, and behind the last gap in powers of two."""
    spark = kept.sparkSession
    ends = kept.groupBy("seq").agg(F.sum("rest").alias("used")).where(F.col("used") < length)
    ends = cut_lineage(ends.withColumn("run", F.floor(F.col("seq") / RUN)), "gaps")
    runs = ends.groupBy("run").agg(F.sum(length - F.col("used")).alias("gap"))
    runs = runs.select("run", (F.sum("gap").over(Window.orderBy("run")) - F.col("gap")).alias("base"))
    inner = F.sum(length - F.col("used")).over(Window.partitionBy("run").orderBy("seq"))
    gaps = ends.withColumn("high", inner).join(runs, "run")
    gaps = gaps.select("seq", "used", (F.col("high") + F.col("base")).alias("high"))
    gaps = gaps.select("seq", "used", (F.col("high") - length + F.col("used")).alias("low"), "high")
    last = ends.agg(F.sum(length - F.col("used"))).first()[0] or 0
    tail, at = [], last
    for bit in range(plan.left.bit_length() - 1, -1, -1):
        if plan.left >> bit & 1:
            tail.append((plan.kept + len(tail), 0, at, at + (1 << bit)))
            at += 1 << bit
    gaps = gaps.union(spark.createDataFrame(tail, "seq long, used long, low long, high long"))
    docs = cut.select("part", "row", "start", F.col("line").alias("from"), (F.col("line") + F.col("rest")).alias("to"))
    docs = on_line(docs.withColumn("low", F.col("from")).withColumn("high", F.col("to"))).drop("low", "high")
    both = on_line(gaps).join(docs, "cell")
    low, high = F.greatest("low", "from"), F.least("high", "to")
    both = both.where((low < high) & (F.floor(low / CELL) == F.col("cell")))
    return both.select("part", "row", (F.col("start") + low - F.col("from")).alias("start"), (high - low).alias("length"),
                       "seq", (F.col("used") + low - F.col("low")).alias("offset"))


def pack(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """``pieces`` of all documents of ``(doc_id, ids)``."""
    return pieces(numbered(df, doc_id, ids, length), length, unit)


def pieces(documents: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """Pieces ``(doc_id, start, length, doc_tokens, sequence_id, offset, ids)`` of all numbered documents;
    ``ids`` are the piece's as little-endian 32-bit numbers. ``unit`` divides ``length``."""
    if length % unit:
        raise ValueError("unit must divide length")
    rows = cut_lineage(documents, "ids")
    meta = rows.drop("ids", "doc")
    held = cut_lineage(meta.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("tokens") / length)).alias("whole")), "lengths")
    by_length = held.where("rest > 0")
    counts = {r.rest: r.n for r in by_length.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # at most ``length`` rows
    plan = planned(counts, length, unit)

    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_length.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rests = meta.where("rest > 0").join(offsets, ["part", "rest"])
    rests = rests.select("part", "row", (F.col("tokens") - F.col("rest")).alias("start"), "rest", (F.col("offset") + F.col("nth")).alias("rank"))
    where = cut_lineage(placed(rests, plan), "places")
    kept = where.where("seq is not null")
    behind = F.sum("rest").over(Window.partitionBy("seq").orderBy("place")) - F.col("rest")
    regular = kept.select("part", "row", "start", F.col("rest").alias("length"), "seq", behind.alias("offset"))
    gaps = filled(where.where("seq is null"), kept, plan, length)

    parts = held.groupBy("part").agg(F.sum("whole").alias("whole"))
    parts = parts.select("part", (F.sum("whole").over(Window.orderBy("part")) - F.col("whole")).alias("base"))
    long = meta.where(F.col("tokens") >= length).join(parts, "part")
    long = long.select("part", "row", F.col("base") + F.col("whole") + plan.kept + plan.left.bit_count(), F.explode(F.sequence(F.lit(0), F.floor(F.col("tokens") / length) - 1)).alias("k")).toDF("part", "row", "seq", "k")
    whole = long.select("part", "row", (F.col("k") * length).alias("start"), F.lit(length).cast("long").alias("length"), (F.col("seq") + F.col("k")).alias("seq"), F.lit(0).cast("long").alias("offset"))

    every = regular.unionByName(gaps).unionByName(whole)
    every = every.groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "seq", "offset"))).alias("pieces"))
    both = rows.select("part", "row", "doc", "tokens", "ids").join(every, ["part", "row"])
    cut = F.transform("pieces", lambda p: F.struct(
        p["start"].alias("start"), p["length"].alias("length"), p["seq"].alias("seq"), p["offset"].alias("offset"),
        F.substring("ids", (4 * p["start"] + 1).cast("int"), (4 * p["length"]).cast("int")).alias("ids")))
    both = both.select("doc", "tokens", F.explode(cut).alias("p"))
    return both.select(F.col("doc").alias("doc_id"), "p.start", "p.length", F.col("tokens").alias("doc_tokens"), F.col("p.seq").alias("sequence_id"),
                       "p.offset", "p.ids")


def matrices(cut: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """One row per sequence: ``ids`` and ``position_ids`` (restarting with each piece) as little-endian 32-bit
    numbers, padded to ``length`` unless the tokens are a power of two; ``cu_seqlens``, ``doc_ids``, ``starts``."""
    every = F.sort_array(F.collect_list(F.struct("offset", "length", "start", "doc_id", "ids")))
    rows = cut.groupBy("sequence_id").agg(every.alias("p"))
    tokens = F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + p["length"])
    rows = rows.select("sequence_id", tokens.alias("n_tokens"), "p")
    rows = rows.withColumn("width", F.when(F.bit_count("n_tokens") == 1, F.col("n_tokens")).otherwise(F.lit(length).cast("long")))
    joined = F.aggregate("p", F.unhex(F.lit("")), lambda b, p: F.concat(b, p["ids"]))
    empty = F.unhex(F.repeat(F.lit(np.array([pad], "<i4").tobytes().hex()), (F.col("width") - F.col("n_tokens")).cast("int")))
    number = lambda k: F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(k, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)])
    counted = F.flatten(F.transform("p", lambda p: F.sequence(F.lit(0).cast("long"), p["length"] - 1)))
    zeros = F.repeat(F.lit("00000000"), (F.col("width") - F.col("n_tokens")).cast("int"))
    places = F.unhex(F.concat(F.array_join(F.transform(counted, number), ""), zeros))
    ends = F.concat(F.transform("p", lambda p: p["offset"]), F.array("n_tokens"))
    return rows.select("sequence_id", "n_tokens", F.concat(joined, empty).alias("ids"), places.alias("position_ids"), ends.alias("cu_seqlens"),
                       F.transform("p", lambda p: p["doc_id"]).alias("doc_ids"), F.transform("p", lambda p: p["start"]).alias("starts"))
