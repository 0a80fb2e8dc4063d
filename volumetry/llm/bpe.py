"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word starts as single symbols. Each leaf of the tree holds the rank of the pair that begins there;
the root is the leftmost pair of lowest rank. A merge changes three leaves, each with one walk to the
root, so a word of n symbols takes O(n log n) steps whatever its length.

Vocabularies are ``tokenizer.json`` files with a BPE model, read by path on the driver and sent to the
tasks (bounded by the size of the file). Rules covered: NFC, white space to one space, lower case, a
split pattern whose pieces never hold white space, byte symbols, a word-end suffix and added tokens
that are looked for in the raw text. Other settings raise an error.

Null text encodes to no ids and decodes to an empty text. Columns of the input with the names of the
results are replaced.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from volumetry.llm.batches import add_columns

# Entries of a worker's cache of white-space-free chunks; its older half goes when it is full.
CACHE_ENTRIES = 400_000
CACHE_CHARS = 64
NONE = 1 << 62


def store(cache: dict[str, bytes], key: str, value: bytes) -> dict[str, bytes]:
    """Adds an entry; a full cache keeps its newer half, as dictionaries are in order of entry."""
    if len(cache) >= CACHE_ENTRIES:
        cache = dict(islice(cache.items(), CACHE_ENTRIES // 2, None))
    cache[key] = value
    return cache


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where visible, else the next code point from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in visible else next(free)) for b in range(256)]


def merge(symbols: list[int], pairs: dict[tuple[int, int], int], joined: list[int]) -> list[int]:
    """Applies merges, lowest rank first and leftmost among equals, until no pair is left. ``pairs`` has
    the rank of a pair and ``joined`` the symbol that a rank makes."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    get = pairs.get
    for i, pair in enumerate(pairwise(symbols), size):
        if (rank := get(pair)) is not None:
            tree[i] = rank * size + i - size
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before, now = [*range(1, n), -1], list(range(-1, n - 1)), list(symbols)
    while (best := tree[1]) != NONE:
        i = best % size
        j = after[i]
        now[i] = joined[best // size]
        k = after[i] = after[j]
        changed = [(j, NONE)]
        if k >= 0:
            before[k] = i
            rank = get((now[i], now[k]))
            changed.append((i, NONE if rank is None else rank * size + i))
        else:
            changed.append((i, NONE))
        if (h := before[i]) >= 0:
            rank = get((now[h], now[i]))
            changed.append((h, NONE if rank is None else rank * size + h))
        for leaf, key in changed:
            node = size + leaf
            tree[node] = key
            while node > 1:
                other = tree[node ^ 1]
                if other < key:
                    key = other
                node >>= 1
                if tree[node] == key:
                    break
                tree[node] = key
    out, i = [], 0
    while i >= 0:
        out.append(now[i])
        i = after[i]
    return out


class Vocabulary:
    """Ids, merges and text rules of one vocabulary file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("a plain BPE model with byte symbols is needed")
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"]:
            raise ValueError("normalisation or splitting of this vocabulary is not supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must stand for themselves in the raw text")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.pairs = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(merges)}
        self.joined = [self.ids[a + b] for a, b in merges]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (*self.ids.items(), *self.added.items())}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.split = regex.compile(splits[0]["pattern"]["Regex"], regex.V0)
        symbols = byte_symbols()
        self.first = [self.ids[s] for s in symbols]
        self.last = [self.ids[s + self.suffix] for s in symbols]
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def word(self, piece: str) -> bytes:
        """Ids of one piece of the split pattern, as the bytes of an int32 array."""
        found = self.words.get(piece)
        if found is None:
            data = piece.encode()
            start = [self.first[b] for b in data[:-1]] + [self.last[data[-1]]]
            found = array("i", merge(start, self.pairs, self.joined)).tobytes()
            if len(piece) <= CACHE_CHARS:
                self.words = store(self.words, piece, found)
        return found

    def chunk(self, chunk: str) -> bytes:
        found = b"".join(map(self.word, self.split.findall(chunk)))
        if len(chunk) <= CACHE_CHARS:
            self.chunks = store(self.chunks, chunk, found)
        return found

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens. No piece crosses white space, so chunks stand alone."""
        text = unicodedata.normalize("NFC", text)
        # lower case goes character by character: a final sigma is no special case
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        # str.split also cuts at four control characters that are no white space for the pattern
        chunks = regex.split(r"\s+", text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        found = list(map(self.chunks.get, chunks))
        if None in found:
            found = [self.chunk(c) if f is None else f for c, f in zip(chunks, found)]
        return b"".join(found)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "int32")
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self.plain(text[at:m.start()]), np.int32(self.added[m.group()]).tobytes()]
            at = m.end()
        out.append(self.plain(text[at:] if at else text))
        return np.frombuffer(b"".join(out), "int32")

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: these files name no decoder of their own."""
        return " ".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[str, Vocabulary] = {}


def load(text: str) -> Vocabulary:
    """One vocabulary a worker process, with its cache."""
    name = hashlib.sha256(text.encode()).hexdigest()
    if name not in _LOADED:
        _LOADED[name] = Vocabulary(text)
    return _LOADED[name]


def send(df: DataFrame, path: str):
    """The vocabulary file as a broadcast variable."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, "int32"), *arrays])))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds the ids of every whole text."""
    sent = send(df, path)

    def run(texts: list) -> list[pa.Array]:
        vocabulary = load(sent.value)
        return [lists([vocabulary.encode(t) for t in texts])]

    return add_columns(df, text, [T.StructField(out, T.ArrayType(T.IntegerType()))], run, keep)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of an id column; null ids give null."""
    sent = send(df, path)
    schema = T.StructType([*(f for f in df.schema if f.name != out), T.StructField(out, T.StringType())])

    def run(batches):
        vocabulary = load(sent.value)
        for batch in batches:
            made = [None if row is None else vocabulary.decode(row) for row in batch.column(ids).to_pylist()]
            cols = [batch.column(n) for n in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(made, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Ids and what they decode to, in one pass over the texts."""
    sent = send(df, path)

    def run(texts: list) -> list[pa.Array]:
        vocabulary = load(sent.value)
        coded = [vocabulary.encode(t) for t in texts]
        return [lists(coded), pa.array([vocabulary.decode(c.tolist()) for c in coded], pa.string())]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return add_columns(df, text, fields, run, keep)
