"""Runs of periodically repeated words, and texts with each run cut down to its first period.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at least
``max(SHORTEST, TIMES * q)`` words that no neighbouring word extends with the same period.

Method: the words of many documents are one array of numbers, a number of its own after each document.
A stretch of 4q words holds a multiple g of 2q with equal words at g, g + q and g + 2q, so for each q the
grid of step 2q gives all places to look at (a harmonic sum of places). At each, the common extensions of
g and g + q to the right and to the left bound the stretch. An extension is found with a difference
cover: only suffixes at the six residues of ``COVER`` modulo 31 are sorted; for any two positions fewer
than 31 words further both are such suffixes, so the words before are compared one by one, and the rest
is a minimum over the common prefixes of neighbours in sorted order, by a sparse table.

Scale: a task takes about 8 MB of text at a time, a longer text alone and whole; nothing is shuffled.
Only documents with a place on the grid where the next words agree as well are sorted. Places are worked
on in chunks, so a text of one word repeated needs no more memory than its own array.

Rules: words are ``[^\\x20\\x09-\\x0D]+``, compared as bytes; null and empty texts have no words, no runs
and an empty collapsed text. Repeated rows are worked on each. Input columns with the names of the
results (``n_words``, ``runs``, ``collapsed``) give way to them. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from volumetry.llm.batches import add_columns

TIMES = 4
SHORTEST = 6
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)  # every difference modulo 31 lies between two of these
PLACES = 1 << 19  # places whose extensions are looked for at once

_slot = np.full(MODULUS, -1)
_slot[list(COVER)] = np.arange(len(COVER))
# for each difference, a member of the cover from which it leads to another
_meet = np.array([next(a for a in COVER if (a + d) % MODULUS in COVER) for d in range(MODULUS)])


class Extensions:
    """Lengths of common prefixes of suffixes of ``words`` (positive int32 numbers)."""

    def __init__(self, words: np.ndarray, longest: int):
        n = len(words)
        self.words = np.concatenate([words, np.arange(words.max(initial=0) + 1, words.max(initial=0) + 2 + 3 * MODULUS)]).astype("int32")
        blocks = n // MODULUS + 1
        self.at = (np.arange(blocks)[:, None] * MODULUS + np.array(COVER)).ravel()
        self.rank = self._sort(longest)
        order = np.empty(len(self.at), "int64")
        order[self.rank] = np.arange(len(self.at))
        table = [self._neighbours(order[:-1], order[1:])]
        step = 1
        while 2 * step <= len(table[0]):
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
            step *= 2
        self.table = table
        del self.names

    def _sort(self, longest: int) -> np.ndarray:
        """Ranks of the sampled suffixes: blocks of 31 words first, then pairs of ever longer blocks."""
        flat = np.lib.stride_tricks.sliding_window_view(self.words, MODULUS)[self.at].astype(">i4")
        _, name = np.unique(np.ascontiguousarray(flat).view(f"S{4 * MODULUS}").ravel(), return_inverse=True)
        self.names = [name.astype("int32")]
        covered, shift = MODULUS, len(COVER)
        while covered < longest + 1 and name.max(initial=0) + 1 < len(name):
            after = np.zeros(len(name), "int64")
            after[:-shift] = name[shift:] + 1
            _, name = np.unique(name * np.int64(len(name) + 1) + after, return_inverse=True)
            self.names.append(name.astype("int32"))
            covered, shift = 2 * covered, 2 * shift
        if name.max(initial=0) + 1 < len(name):  # suffixes in the padding behind the last word
            name = np.argsort(np.argsort(name, kind="stable"), kind="stable")
        return name

    def _neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of sampled suffixes, from the longest equal blocks down to words."""
        found = np.zeros(len(a), "int64")
        a, b = a.copy(), b.copy()
        last = len(self.at)
        for k in range(len(self.names) - 1, -1, -1):
            inside = np.flatnonzero((a < last) & (b < last))
            same = inside[self.names[k][a[inside]] == self.names[k][b[inside]]]
            found[same] += MODULUS << k
            a[same] += len(COVER) << k
            b[same] += len(COVER) << k
        place = lambda s: s // len(COVER) * MODULUS + np.array(COVER)[s % len(COVER)]
        return found + self._compare(place(a), place(b), np.full(len(a), MODULUS))

    def _compare(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and ``j`` on, at most ``limit`` each."""
        found = np.zeros(len(i), "int64")
        open_ = np.arange(len(i))
        words, end = self.words, len(self.words) - 1
        for t in range(int(limit.max(initial=0))):
            open_ = open_[limit[open_] > t]
            x, y = i[open_] + t, j[open_] + t
            open_ = open_[(words[np.minimum(x, end)] == words[np.minimum(y, end)]) & (x <= end) & (y <= end)]
            if not len(open_):
                break
            found[open_] += 1
        return found

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and from ``j`` on, for arrays of different positions ``i < j``."""
        ahead = (_meet[(j - i) % MODULUS] - i) % MODULUS
        found = self._compare(i, j, ahead)
        on = np.flatnonzero(found == ahead)
        sample = lambda p: p // MODULUS * len(COVER) + _slot[p % MODULUS]
        x, y = sample(i[on] + ahead[on]), sample(j[on] + ahead[on])
        inside = y < len(self.at)
        on, x, y = on[inside], self.rank[x[inside]], self.rank[y[inside]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(high - low)[1] - 1
        least = np.empty(len(on), "int64")
        for k in np.unique(level):
            of = level == k
            least[of] = np.minimum(self.table[k][low[of]], self.table[k][high[of] - (1 << k)])
        found[on] += least
        return found


def places(words: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(q, positions)`` on the grid of each period where the words that a run would hold agree."""
    n = len(words)
    for q in range(1, longest // TIMES + 1):
        first = words[:max(0, n - 2 * q):2 * q]
        second = words[q::2 * q][:len(first)]
        hit = np.flatnonzero((first == second) & (second == words[2 * q::2 * q][:len(first)]))
        if not len(hit):
            continue
        g = hit.astype("int64") * (2 * q)
        if q > 1:
            g = g[(words[g + 1] == words[g + q + 1]) & (words[g + q - 1] == words[g + 2 * q - 1])]
        if len(g):
            yield q, g


def stretches(words: np.ndarray, longest: int) -> np.ndarray:
    """Runs ``(start, end, period)`` of an array of words, by start and period. Documents of at most
    ``longest`` words end with a number that is nowhere else."""
    found: list[np.ndarray] = []
    near: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    looked: tuple[Extensions, Extensions] | None = None

    def bounded() -> None:
        nonlocal near, held, looked, found
        if looked is None:
            looked = Extensions(words, longest), Extensions(words[::-1], longest)
        q = np.concatenate([a for a, _ in near])
        g = np.concatenate([b for _, b in near])
        near, held = [], 0
        end = g + q + looked[0].common(g, g + q)
        n = len(words)
        left = np.zeros(len(g), "int64")
        inner = np.flatnonzero(g > 0)
        left[inner] = looked[1].common(n - (g + q)[inner], n - g[inner])
        start = g - left
        ok = end - start >= np.maximum(SHORTEST, TIMES * q)
        rows = np.stack([start[ok], end[ok], q[ok]], 1)
        rows = np.concatenate([*found, rows])
        # of all periods of one stretch the smallest
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        found = [rows[new]]

    for q, g in places(words, longest):
        for at in range(0, len(g), PLACES):
            part = g[at:at + PLACES]
            near.append((np.full(len(part), q), part))
            held += len(part)
            if held >= PLACES:
                bounded()
    if near:
        bounded()
    rows = found[0] if found else np.zeros((0, 3), "int64")
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def periodic(texts: Sequence[bytes | None]) -> tuple[list[int], list[np.ndarray], list[bytes]]:
    """Number of words, runs ``(start, length, period)`` and collapsed text of each text in UTF-8."""
    split = [(t or b"").split() for t in texts]
    sizes = np.array([len(w) for w in split], "int64")
    number = {w: i for i, w in enumerate(set().union(*map(set, split)), 1)}
    flat = np.empty(int(sizes.sum()) + len(split), "int32")
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    for i, w in enumerate(split):
        flat[starts[i]:starts[i + 1] - 1] = np.fromiter(map(number.__getitem__, w), "int32", len(w))
        flat[starts[i + 1] - 1] = len(number) + 1 + i
    # documents with a place on the grid, and of these the exact runs
    longest = int(sizes.max(initial=0))
    some = np.zeros(len(split), bool)
    for _, g in places(flat, longest):
        some[np.searchsorted(starts, g, "right") - 1] = True
    runs = [np.zeros((0, 3), "int64")] * len(split)
    chosen = np.flatnonzero(some)
    if len(chosen):
        words = np.concatenate([flat[starts[i]:starts[i + 1]] for i in chosen])
        begin = np.concatenate([[0], np.cumsum(sizes[chosen] + 1)])
        rows = stretches(words, int(sizes[chosen].max()))
        owner = np.searchsorted(begin, rows[:, 0], "right") - 1
        cut = np.searchsorted(owner, np.arange(len(chosen) + 1))
        for k, i in enumerate(chosen):
            mine = rows[cut[k]:cut[k + 1]]
            runs[i] = np.stack([mine[:, 0] - begin[k], mine[:, 1] - mine[:, 0], mine[:, 2]], 1)
    collapsed = []
    for w, r in zip(split, runs):
        if len(r):
            depth = np.zeros(len(w) + 1, "int64")
            np.add.at(depth, r[:, 0] + r[:, 2], 1)
            np.add.at(depth, r[:, 0] + r[:, 1], -1)
            w = [w[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
        collapsed.append(b" ".join(w))
    return sizes.tolist(), runs, collapsed


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def with_runs(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_words``, ``runs`` (by start, then period) and ``collapsed``, the text without the words
    of a run after its first period."""
    def run(texts: list) -> list[pa.Array]:
        sizes, runs, collapsed = periodic(texts)
        rows = np.concatenate([*runs, np.zeros((0, 3), "int64")])
        ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype("int32")
        structs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["start", "length", "period"])
        return [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), structs),
                pa.array(collapsed, pa.binary()).cast(pa.string())]

    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    return add_columns(df, text, fields, run, keep, binary=True)
