"""Packing token ids into rows of one length by best-fit decreasing, as binary matrices.

Documents longer than a row are split into whole rows and a rest, losslessly. Pieces go by falling
length into the row with the least room that still takes them; a segment tree over room sizes finds it
in O(log length). A shard of at most about ``SHARD`` tokens is packed at a time, taken from the stream of
one partition, so memory is bounded, nothing is shuffled, and a lost task packs the same shard again.

A result row is one row of the matrix: little-endian ids and positions (restarting with each piece) as
binary, cumulative segment lengths from 0, and document and offset of each segment. Which documents share
a row depends on the partitions; that every token is there once, in order, does not. Documents without
ids (null or empty) have no tokens to place and appear in no row. Repeated documents are packed each.

``encode`` makes the ids from a file of ranks with the tiktoken library; ids of other encoders do as well.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from volumetry.llm.batches import add_columns
from volumetry.llm.bpe import lists, send

LENGTH = 2048
SHARD = 1 << 20


class Rooms:
    """Open rows by room left; ``take(n)`` gives one with the least room of at least ``n``."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]
        self.some = [0] * (2 * self.size)  # open rows below each node

    def count(self, room: int, by: int) -> None:
        node = self.size + room
        while node:
            self.some[node] += by
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self.count(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        node = self.size + least
        if not self.some[node]:
            # up to the first right neighbour with a row, then down to its leftmost leaf
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not self.some[node]:
                    node += 1
        room = node - self.size
        self.count(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Pieces of each row, by falling length (equal ones in their order)."""
    rooms, rows = Rooms(length), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        if found is None:
            rows.append([])
            found = (length, len(rows) - 1)
        room, row = found
        rows[row].append(i)
        if room > lengths[i]:
            rooms.put(room - lengths[i], row)
    return rows


BLANK = re.compile(r"\s{4096}")
_LOADED: dict[str, tiktoken.Encoding] = {}


def encoder(ranks: str, pattern: str) -> tiktoken.Encoding:
    """One encoder a worker process, from lines of a token in base 64 and its rank."""
    name = hashlib.sha256(f"{pattern}\n{ranks}".encode()).hexdigest()
    if name not in _LOADED:
        table = {base64.b64decode(a): int(b) for a, b in map(str.split, filter(None, ranks.splitlines()))}
        _LOADED[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _LOADED[name]


def text_ids(use: tiktoken.Encoding, text: str | None) -> np.ndarray:
    """Ids of a whole text. The library's pattern fails on a million blanks in a row, so texts are cut
    after every 4096 blanks on end; the ids still decode to the text."""
    at, parts = 0, []
    for m in BLANK.finditer(text or ""):
        parts.append(text[at:m.end()])
        at = m.end()
    parts.append((text or "")[at:])
    ids = [use.encode_to_numpy(p, disallowed_special=()) for p in parts]
    return np.concatenate(ids).astype("int32")


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds the ids of every whole text; null has none. Strings of control tokens are ordinary text."""
    sent = send(df, path)

    def run(texts: list) -> list[pa.Array]:
        use = encoder(sent.value, pattern)
        return [lists([text_ids(use, t) for t in texts])]

    return add_columns(df, text, [T.StructField(out, T.ArrayType(T.IntegerType()))], run, keep)


SCHEMA = ("part int, shard int, row int, n_tokens int, n_segments int, ids binary, position_ids binary, "
          "cu_seqlens array<int>, doc_ids array<bigint>, starts array<int>")


def pack(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Packs ``(doc_id, ids)``. Ids and positions take four bytes each."""
    def packed(held: list[tuple[int, np.ndarray]], part: int, number: int) -> pa.RecordBatch:
        parts = [(doc, at, a[at:at + length]) for doc, a in held for at in range(0, len(a), length)]
        rows = best_fit([len(p[2]) for p in parts], length)
        cols: list[list] = [[] for _ in range(10)]
        for r, row in enumerate(rows):
            flat = np.concatenate([parts[i][2] for i in row])
            sizes = [len(parts[i][2]) for i in row]
            places = np.concatenate([np.arange(n) for n in sizes])
            values = (part, number, r, len(flat), len(row), flat.astype("<i4").tobytes(), places.astype("<i4").tobytes(),
                      np.cumsum([0, *sizes]).tolist(), [parts[i][0] for i in row], [parts[i][1] for i in row])
            for c, v in zip(cols, values):
                c.append(v)
        kinds = [pa.int32()] * 5 + [pa.binary()] * 2 + [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, tokens = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            column = batch.column(1)
            offsets, flat = np.asarray(column.offsets), column.values.to_numpy(zero_copy_only=False)
            for i, (doc, ok) in enumerate(zip(batch.column(0).to_pylist(), column.is_valid().to_pylist())):
                a = flat[offsets[i]:offsets[i + 1]]
                if ok and len(a):
                    held.append((doc, a))
                    tokens += len(a)
                if tokens >= shard:
                    yield packed(held, part, number)
                    number, held, tokens = number + 1, [], 0
        if held:
            yield packed(held, part, number)

    return df.select(doc_id, ids).mapInArrow(run, SCHEMA)
