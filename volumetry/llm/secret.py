"""Secret scans: patterns, and two character Markov models told apart by their log-likelihood ratio.

One model is trained on random strings, one on ordinary identifiers. Both are tables of log
probabilities of a character given the two before it, over ``CLASSES`` kinds of characters. The labelled
samples come from the corpus itself: the values that the patterns find are random strings; the words,
numbers, dates, paths and addresses of the rest, the names before such values, and identifiers joined
from the words in the usual styles (``ordinary``) are ordinary ones. The tasks count, one small sum gathers the
counts, so the model has a fixed size. Training reads a bounded share of the documents (``SAMPLE`` of
them, by a hash of the id; documented bound of a classifier fit) or, if none is asked for, all of them; scanning
reads every whole text.

A further candidate is a run of key characters of 16 or more; where a pattern has found a part of it,
what is left on either side. It is a secret if the mean log-likelihood ratio per character is above
``MARGIN``.

Null and empty texts have no spans. Spans are in code points, end exclusive. Repeated rows are rows like
any other; an input column with the name of a result is replaced.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volumetry.llm.batches import add_columns, chosen, pieces

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
NAMED = re.compile("password|passwd|secret|token|api_?key", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]+")
MIXED = re.compile("[A-Za-z][0-9]|[0-9][A-Za-z]")
MARK = "[SECRET]"

SAMPLE = 20_000
MARGIN = 0.9  # nats per character
UNSEEN = 0.01  # share of characters that follow no context, in either model
HELD = 1 << 20  # characters that are counted at once
REST = 4  # characters of a part of a run beside a span of the patterns
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
CLASSES = len(ALPHABET) + 1  # and the edge of a string
PLACE = np.full(128, -1, "int64")
PLACE[[ord(c) for c in ALPHABET]] = np.arange(1, CLASSES)


def codes(text: str) -> np.ndarray:
    """Number of each character, after two edges; others are left out."""
    data = np.frombuffer(text.encode("ascii", "ignore"), "u1")
    placed = PLACE[data]
    return np.concatenate([[0, 0], placed[placed > 0]])


def steps(text: str) -> np.ndarray:
    """Number of each run of three characters."""
    c = codes(text)
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def many_steps(words: list[str]) -> np.ndarray:
    """The numbers of ``steps`` of all words at once."""
    data = np.frombuffer("\n\n".join(words).encode("ascii", "ignore"), "u1")
    placed = PLACE[data]
    placed[data == 10] = 0
    c = np.concatenate([[0, 0], placed[placed >= 0]])
    return ((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:])[c[2:] > 0]


def patterns(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of what the patterns find, by start and kind."""
    low = text.lower() if text.isascii() else None
    # a search for the plain names first, which is cheap; the pattern itself decides
    likely = NAMED.search(text) if low is None else any(w in low for w in ("passw", "secret", "token", "api"))
    out = [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if likely else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def ordinary(text: str, names: list[str]) -> list[str]:
    """The second sample from one text: its words, numbers, dates, paths and addresses, each once; the
    given names; and identifiers joined from its words in the usual styles, with numbers in every other
    one. Runs that are still to be decided (long, letters and digits mixed between separators) are left out."""
    found = list(dict.fromkeys(TOKEN.findall(text)))
    out = [w for w in found if not any(len(p) >= 16 and MIXED.search(p) for p in re.split("[+/_=.-]", w))] + names
    plain = [w.lower() for w in found if w.isalpha() and len(w) < 16]
    for i, at in enumerate(range(0, len(plain) - 2, 3)):
        w = plain[at:at + 3]
        n = zlib.crc32("".join(w).encode())
        if i % 2:
            year, month, day, few = 1990 + n % 45, n // 64 % 12 + 1, n // 1024 % 28 + 1, n >> 16
            hour, minute, second = few % 24, few // 24 % 60, n % 60
            w += [(f"v{few % 10}", f"{few % 10}", f"{few % 1000}", f"{year}", f"{year}{month:02}{day:02}", f"{few}",
                   f"{year}-{month:02}-{day:02}", f"{year}-{month:02}-{day:02}T{hour:02}-{minute:02}-{second:02}Z")[n // 7 % 8]]
            w = w[n % 4:] + w[:n % 4]
        style = i // 2 % 7
        if style == 4:
            out.append(w[0] + "".join(x.capitalize() for x in w[1:]))
        elif style == 5:
            out.append("".join(x.capitalize() for x in w))
        elif style == 6:
            out.append("_".join(w).upper())
        else:
            out.append(("", "", "", "/")[style] + "_-./"[style].join(w))
    return out


class Markov:
    """Log-likelihood ratios of three-character runs: random over ordinary."""

    def __init__(self, random: np.ndarray, plain: np.ndarray):
        self.ratio = (self.logs(random) - self.logs(plain)).ravel()

    @staticmethod
    def logs(counts: np.ndarray) -> np.ndarray:
        """Two characters back, smoothed by one back, smoothed by none; names in words that the corpus lacks
        keep a share of their own, so large counts don't make an unknown context a proof."""
        three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + CLASSES)
        p2 = (two + 8 * p1) / (two.sum(axis=1, keepdims=True) + 8)
        p3 = (three + 8 * p2[None]) / (three.sum(axis=2, keepdims=True) + 8)
        return np.log((1 - UNSEEN) * p3 + UNSEEN * p1)

    def mean(self, text: str) -> float:
        at = steps(text)
        return float(self.ratio[at].mean()) if len(at) else 0.0


def merged(base: list[tuple[int, int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans of the patterns cover, in order and apart."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e, _, _ in sorted(base):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def left(text: str, start: int, end: int, covered: tuple[list[int], list[int]]) -> list[tuple[int, int]]:
    """The parts of a run outside the covered stretches; the whole run if none touches it. Separators
    at the ends of a part are left out, and parts shorter than ``REST``."""
    starts, ends = covered
    first, last = bisect_right(ends, start), bisect_left(starts, end)
    if first >= last:
        return [(start, end)]
    out = []
    for s, e in [*zip(starts[first:last], ends[first:last]), (end, end)]:
        part = text[start:max(start, s)]
        a = start + len(part) - len(part.lstrip("+/_=-"))
        b = a + len(part.strip("+/_=-"))
        if b - a >= REST:
            out.append((a, b))
        start = max(start, e)
    return out


def spans(text: str | None, model: Markov) -> list[tuple[int, int, str]]:
    """All spans of a text: those of the patterns, and runs that the model takes for random."""
    if not text:
        return []
    base = patterns(text)
    out = [(s, e, k) for s, e, k, _ in base]
    covered = merged(base)
    for m in RUN.finditer(text):
        for start, end in left(text, m.start(), m.end(), covered):
            if model.mean(text[start:end]) > MARGIN:
                out.append((start, end, 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int | None = SAMPLE) -> Markov:
    """Counts of both models over about ``sample`` documents, over all without a sample."""
    some = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if sample is not None:
        some = some.where(chosen(F.xxhash64("doc_id"), sample, df.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [np.zeros(CLASSES**3, "int64"), np.zeros(CLASSES**3, "int64")]
        held: list[np.ndarray] = []

        def add() -> None:
            if held:
                kinds[1] += np.bincount(np.concatenate(held), minlength=CLASSES**3)
                held.clear()

        for batch in batches:
            for piece in pieces(batch, "text"):
                for t in piece.column("text").to_pylist():
                    if not t:
                        continue
                    found = patterns(t)
                    for _, _, _, value in found:
                        np.add.at(kinds[0], steps(value), 1)
                    rest, at = [], 0
                    for s, e, _, _ in found:
                        rest.append(t[at:s])
                        at = max(at, e)
                    rest.append(t[at:])
                    names = [m[1] for m in ASSIGN.finditer(t)] if NAMED.search(t) else []
                    held.append(many_steps(ordinary(" ".join(rest), names)))
                    if sum(map(len, held)) > HELD:
                        add()
        add()
        for kind, counts in enumerate(kinds):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
                                             names=["kind", "at", "n"])

    counts = some.mapInArrow(run, "kind int, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n"))
    tables = [np.zeros(CLASSES**3), np.zeros(CLASSES**3)]
    for kind, at, n in counts.collect():  # at most 2 x CLASSES^3 rows
        tables[kind][at] = n
    # a corpus without secrets still has a model: uniform over letters and digits
    tables[0] += 1e-3
    return Markov(*tables)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def scan(df: DataFrame, model: Markov, text: str = "text", out: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """Adds all spans of every whole text."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # two tables of CLASSES^3 numbers

    def run(texts: list) -> list[pa.Array]:
        found = [[{"start": s, "end": e, "kind": k} for s, e, k in spans(t, sent.value)] for t in texts]
        return [pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))]

    return add_columns(df, text, [T.StructField(out, SPANS)], run, keep)


def redact(text: str | None, model: Markov) -> str | None:
    """The text with every secret, overlapping ones as one, replaced by a mark."""
    found = spans(text, model)
    if not found:
        return text
    out, at = [], 0
    for start, end, _ in found:
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, model: Markov, text: str = "text") -> DataFrame:
    """The rows with secrets replaced in their texts; columns and their order stay."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list[pa.Array]:
        return [pa.array([redact(t, sent.value) for t in texts], pa.string())]

    return add_columns(df, text, [T.StructField(text, T.StringType())], run).select(*df.columns)
