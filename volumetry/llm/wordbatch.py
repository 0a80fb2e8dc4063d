"""Ids of many texts at once under a BPE vocabulary with word ends, equal to those of the tokenizers library.

Different pieces of a batch are merged together: pieces of equal length are rows of one matrix, and each
round merges in every row its leftmost pair of lowest rank, so all rows stay equally long. Texts are cut at
white space first and chunks already seen come from a cache of bounded size, whose newer half goes when it is full. Texts that hold an added token
and chunks over ``CACHE_CHARS`` take the plain path of ``bpe``.
"""

from __future__ import annotations

import hashlib
import unicodedata
from itertools import islice

import numpy as np
import regex

from volumetry.llm import bpe

NEVER = np.int32(2**31 - 1)
CACHE = 300_000  # chunks and pieces that a worker remembers, each


class Batch(bpe.Vocabulary):
    def __init__(self, text: str):
        super().__init__(text)
        keys = np.array([a << 32 | b for a, b in self.pairs], "int64")
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.arange(len(keys), dtype="int32")[order]
        self.made = np.array(self.joined, "int32")
        self.begin, self.finish = np.array(self.first, "int32"), np.array(self.last, "int32")

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype("int64") << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merged(self, symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows of equally many symbols after all merges, as ``(row numbers, ids)`` of equal lengths."""
        rows, out = np.arange(len(symbols)), []
        ranks = np.full(symbols.shape, NEVER)
        if symbols.shape[1] > 1:
            ranks[:, :-1] = self.rank(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            i = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), i]
            going = best != NEVER
            if not going.all():
                out.append((rows[~going], symbols[~going]))
                rows, symbols, ranks, i, best = rows[going], symbols[going], ranks[going], i[going], best[going]
            if not len(rows):
                break
            n, width = symbols.shape
            every = np.arange(n)
            symbols[every, i] = self.made[best]
            stay = np.ones((n, width), bool)
            stay[every, i + 1] = False
            # the rank of the second symbol's pair goes with it
            symbols, ranks = symbols[stay].reshape(n, -1), ranks[stay].reshape(n, -1)
            last = i == width - 2
            ranks[every[last], i[last]] = NEVER
            right = every[~last]
            ranks[right, i[right]] = self.rank(symbols[right, i[right]], symbols[right, i[right] + 1])
            left = every[i > 0]
            ranks[left, i[left] - 1] = self.rank(symbols[left, i[left] - 1], symbols[left, i[left]])
        return out

    def learn(self, pieces: list[str]) -> None:
        """Adds pieces to the cache of pieces."""
        data = [p.encode() for p in pieces]
        sizes = np.array(list(map(len, data)))
        found: list[bytes] = [b""] * len(data)
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            raw = np.frombuffer(b"".join(data[k] for k in which), "u1").reshape(len(which), size)
            symbols = self.begin[raw]
            symbols[:, -1] = self.finish[raw[:, -1]]
            for rows, ids in self.merged(symbols):
                flat, step = ids.astype("int32").tobytes(), 4 * ids.shape[1]
                for n, k in enumerate(which[rows].tolist()):
                    found[k] = flat[n * step:(n + 1) * step]
        self.words.update(zip(pieces, found))

    def learn_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of new chunks, which hold no white space; the cache takes them in."""
        for cache in ("chunks", "words"):
            held = getattr(self, cache)
            if len(held) > CACHE:
                # the words seen first are the common ones
                setattr(self, cache, dict(islice(held.items(), CACHE // 2)))
        short = [c for c in chunks if len(c) <= bpe.CACHE_CHARS]
        pieces = [self.split.findall(c) for c in short]
        unknown = list({p for ps in pieces for p in ps if p not in self.words})
        if unknown:
            self.learn(unknown)
        get = self.words.__getitem__
        found = {c: b"".join(map(get, ps)) for c, ps in zip(short, pieces)}
        self.chunks.update(found)
        return found

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as 32-bit numbers; null and empty texts have none."""
        get = self.chunks.get
        done: list[list[bytes | None]] = []
        missing: list[tuple[int, list[int], list[str]]] = []
        for n, text in enumerate(texts):
            if not text or self.specials.search(text):
                done.append([self.encode(text).tobytes()])
                continue
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
            chunks = regex.split(r"\s+", text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
            found = list(map(get, chunks))
            if None in found:
                at = [i for i, f in enumerate(found) if f is None]
                missing.append((n, at, [chunks[i] for i in at]))
            done.append(found)
        if missing:
            new = self.learn_chunks({c for _, _, chunks in missing for c in chunks})
            for n, at, chunks in missing:
                found = done[n]
                for i, c in zip(at, chunks):
                    found[i] = new[c] if c in new else self.chunk(c)
        return [b"".join(f) for f in done]


_LOADED: dict[str, Batch] = {}


def load(text: str) -> Batch:
    """One vocabulary a worker process, with its caches."""
    name = hashlib.sha256(text.encode()).hexdigest()
    if name not in _LOADED:
        _LOADED[name] = Batch(text)
    return _LOADED[name]
