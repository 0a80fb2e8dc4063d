"""Language ID: averaged embeddings of hashed character n-grams and a linear softmax.

Each text is the mean embedding of its runs of two and three characters (lower case), hashed into
``BUCKETS`` rows; a linear layer gives one logit per language. Both are trained by stochastic gradient
descent in numpy on a bounded sample of labelled texts (about ``SAMPLE`` different texts of each language, by
their hashes; copies count once, so a large group of copies doesn't fill the sample, and a rare language keeps
its texts). Every fifth text of a language is held apart to fit the temperature of the softmax and the
score below which a prediction is rejected. The driver holds the sample: languages are taken to be few, hundreds at most. Every whole text is then scored in the tasks with the
product of both layers (buckets x languages).

At equal scores the first language in order wins. Null texts and texts without a letter are ``und`` with score 0. Without labelled rows everything is.
Repeated rows are rows like any other; input columns with the names of results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volumetry.llm.batches import add_columns, chosen, pieces

BUCKETS = 1 << 15
SIZE = 16
SAMPLE = 500  # texts of a language
BATCH = 32
STEPS = 300  # gradient steps; more if an epoch takes more
RATE = 4.0
TRUST = 0.99  # share of right answers among the accepted ones, on the rows held apart
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def grams(text: str) -> np.ndarray:
    """Buckets of all runs of two and three characters."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "ignore"), "<u4")
    two = c[:-1] * np.uint32(2654435761) + c[1:] * np.uint32(40503)
    three = two[:-1] * np.uint32(31) + c[2:] * np.uint32(2246822519)
    return np.concatenate([two >> 17, three >> 17]).astype("int64")


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def scores(self, text: str) -> np.ndarray:
        logits = (self.table[grams(text)].mean(axis=0, dtype="float64") + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        p = self.scores(text)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def descend(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, weights and bias after ``STEPS`` steps, in whole epochs over (buckets, shares) rows."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype("float32")
    out = rng.normal(0, 0.1, (SIZE, n)).astype("float32")
    bias = np.zeros(n, "float32")
    epochs = -(-STEPS * BATCH // len(rows))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        rate = RATE * (1 - epoch / epochs)
        for start in range(0, len(order), BATCH):
            chosen = order[start:start + BATCH]
            at = np.concatenate([rows[i][0] for i in chosen])
            share = np.concatenate([rows[i][1] for i in chosen])
            begins = np.cumsum([0, *(len(rows[i][0]) for i in chosen[:-1])])
            mean = np.add.reduceat(emb[at] * share[:, None], begins, axis=0)
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), target[chosen]] -= 1
            p /= len(chosen)
            back = np.repeat(p @ out.T, np.diff([*begins, len(at)]), axis=0) * share[:, None]
            out -= rate / 4 * (mean.T @ p)
            bias -= rate / 4 * p.sum(axis=0)
            by = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[by], prepend=-1))
            emb[at[by][cuts]] -= rate * 8 * np.add.reduceat(back[by], cuts, axis=0)
    return emb, out, bias


def calibrated(model: Model, texts: list[np.ndarray], target: np.ndarray) -> Model:
    """Temperature by likelihood, and the least score that keeps wrong answers rare."""
    logits = np.array([model.table[t].mean(axis=0, dtype="float64") + model.bias for t in texts])

    def soft(temperature: float) -> np.ndarray:
        p = np.exp((logits - logits.max(axis=1, keepdims=True)) / temperature)
        return p / p.sum(axis=1, keepdims=True)

    model.temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(soft(t)[np.arange(len(target)), target] + 1e-12).mean())
    p = soft(model.temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == target
    for i in np.argsort(best):
        if right[best >= best[i]].mean() >= TRUST:
            model.least = float(best[i])
            break
    else:
        model.least = 1.0
    return model


def train(rows: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, seed: int = 7) -> Model:
    """Learns from about ``sample`` different texts with a letter of each language."""
    good = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    different = good.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()  # a row a language
    kept = F.lit(False)
    for r in different:
        kept = F.when(F.col("lang") == r.lang, chosen(F.xxhash64("text"), sample, r.n)).otherwise(kept)
    # copies merge before the shuffle, so what is moved is the sample
    some = good.where(kept).dropDuplicates(["text", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                lang, at, share = [], [], []
                for t, name in zip(piece.column("text").to_pylist(), piece.column("lang").to_pylist()):
                    if LETTER.search(t):
                        found, counts = np.unique(grams(t), return_counts=True)
                        lang.append(name), at.append(found.astype("<i4").tobytes()), share.append((counts / counts.sum()).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(at, pa.binary()), pa.array(share, pa.binary())],
                                                 names=["lang", "at", "share"])

    found = some.mapInArrow(run, "lang string, at binary, share binary").toArrow().to_pydict()  # the sample
    order = sorted(range(len(found["lang"])), key=lambda i: (found["lang"][i], found["at"][i], found["share"][i]))
    languages = sorted(set(found["lang"]))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), "float32"), np.zeros(0, "float32"))
    target = np.array([languages.index(found["lang"][i]) for i in order])
    data = [(np.frombuffer(found["at"][i], "<i4").astype("int64"), np.frombuffer(found["share"][i], "<f4")) for i in order]
    apart = (np.arange(len(data)) - np.searchsorted(target, target)) % 5 == 4
    inner = np.flatnonzero(~apart)
    emb, out, bias = descend([data[i] for i in inner], target[inner], len(languages), seed)
    model = Model(languages, (emb @ out).astype("float32"), bias)
    held = np.flatnonzero(apart)
    if len(held) >= 20:
        again = [np.repeat(data[i][0], np.maximum(1, np.rint(data[i][1] / data[i][1].min()).astype(int))) for i in held]
        model = calibrated(model, again, target[held])
    return model


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``accepted`` for every whole text."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # buckets x languages

    def run(texts: list) -> list[pa.Array]:
        found = [sent.value.predict(t) for t in texts]
        score = np.array([s for _, s in found])
        return [pa.array([n for n, _ in found], pa.string()), pa.array(score, pa.float64()),
                pa.array((score >= sent.value.least) & np.array([n != UNKNOWN for n, _ in found], bool), pa.bool_())]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    return add_columns(df, text, fields, run, keep)
