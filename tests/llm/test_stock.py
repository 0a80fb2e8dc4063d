"""Cutting-stock packing: ids as the tokenizers library gives them, every id in one piece, no padding."""

import zlib

import numpy as np
import pytest

from tests.llm.conftest import prose
from volumetry.llm import queries, stock


def library(texts):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(queries.word_vocabulary())
    made.no_truncation()
    made.no_padding()
    return [e.ids for e in made.encode_batch(["" if t is None else t for t in texts], add_special_tokens=False)]


def ids(spark, lengths):
    rows = [(i, [(7 * i + k) % 1000 for k in range(n)]) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "doc_id long, ids array<int>"), dict(rows)


def held(pieces, docs, length):
    """Every id is there once and in order, sequences have no hole; gives the tokens of each sequence."""
    seqs, found = {}, {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
        found.setdefault(p.doc_id, []).append((p.start, np.frombuffer(p.ids, "<i4").tolist()))
        assert p.length * 4 == len(p.ids) and p.length > 0 and p.doc_tokens == len(docs[p.doc_id])
    for doc, want in docs.items():
        at = 0
        for start, part in sorted(found.get(doc, [])):
            assert start == at
            assert part == list(want[start:start + len(part)])
            at += len(part)
        assert at == len(want)
    out = {}
    for s, parts in seqs.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
        out[s] = at
    return out


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    want = {d.doc_id: [*i, 2] for d, i in zip(docs, library([d.text for d in docs]))}
    rows = queries.RUNS["op13_cutting_stock"](spark, data).collect()
    seqs, seen = {}, {}
    for r in rows:
        part = np.array(want[r.doc_id][r.start:r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(want[r.doc_id])
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(seen) == set(want)
    for parts, total in [*((p, len(want[d])) for d, p in seen.items()), *((p, None) for p in seqs.values())]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert total is None or at == total
    sums = [sum(n for _, n in p) for p in seqs.values()]
    assert all(s == 4096 or s < 4096 and s & (s - 1) == 0 for s in sums)
    assert len(rows) < len(docs) + 2 * len(seqs)


@pytest.mark.parametrize("lengths", [[], [0, 0], [5], [4096, 8192, 4097], [1] * 300, [3000] * 50 + [1095] * 50 + [1] * 50, [4095] * 20])
def test_lengths(spark, lengths):
    df, docs = ids(spark, lengths)
    out = stock.pack(df.repartition(5))
    sums = held(out.collect(), docs, 4096)
    assert sum(sums.values()) == sum(lengths)
    assert sum(s < 4096 for s in sums.values()) == (sum(lengths) % 4096).bit_count()


def test_few_documents_are_cut(spark, rng):
    lengths = [min(4095, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(3000)]
    df, docs = ids(spark, lengths)
    pieces = stock.pack(df.repartition(7)).collect()
    sums = held(pieces, docs, 4096)
    by_doc = {}
    for p in pieces:
        by_doc[p.doc_id] = by_doc.get(p.doc_id, 0) + 1
    assert sum(n > 1 for n in by_doc.values()) < 0.3 * len(sums)  # cutting a stream in order cuts one for each sequence


def test_program_meets_its_bound(rng):
    widths = np.array([47, 40, 30, 23, 12, 7][::-1])
    demand = np.array([rng.randint(200, 900) for _ in widths])
    rows, uses = stock.cutting(100, widths, demand)
    assert (uses @ rows == demand).all() and ((rows @ widths) <= 100).all()
    lower = (demand * widths).sum() / 100
    assert uses.sum() <= 1.03 * lower + len(widths)
    # 100 of 50 + 33 and the other 200 of 33 by threes
    rows, uses = stock.cutting(99, np.array([33, 50]), np.array([300, 100]))
    assert uses.sum() == 167


def test_knapsack_against_all_multisets():
    widths, values = np.array([3, 4, 7]), np.array([0.31, 0.45, 0.8])
    best, copies = stock.priced(17, widths, values)
    every = max(0.31 * a + 0.45 * b + 0.8 * c for a in range(6) for b in range(5) for c in range(3) if 3 * a + 4 * b + 7 * c <= 17)
    assert best == pytest.approx(every) and (copies @ widths) <= 17 and copies @ values == pytest.approx(best)


def test_matrices(spark, rng):
    df, docs = ids(spark, [rng.randint(1, 40) for _ in range(60)] + [200])
    rows = stock.matrices(stock.pack(df, length=64, unit=4), length=64, pad=9).collect()
    back = {}
    for r in rows:
        flat, places = np.frombuffer(r.ids, "<i4"), np.frombuffer(r.position_ids, "<i4")
        assert len(flat) == len(places) and (len(flat) == 64 or r.n_tokens == len(flat))
        assert (flat[r.n_tokens:] == 9).all() and r.cu_seqlens[-1] == r.n_tokens
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            back.setdefault(d, []).append((s, flat[a:b].tolist()))
            assert places[a:b].tolist() == list(range(b - a))
    assert {d: [x for _, part in sorted(p) for x in part] for d, p in back.items()} == docs


def test_ids_of_odd_texts(spark, odd, none, rng):
    texts = ["ΑΣ Σ ÀÉ ſ K 漢字 😀 é \x1c a\x1db　x\x85y", "<|endoftext|> hi<|startoftext|>b", "it's we'll I'VE 12345 ab12 !!! ...a", "x" * 5000, " \n", "", None]
    texts += [prose(rng, 50) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc: np.frombuffer(r.ids, "<i4").tolist() for r in stock.encoded(df, queries.word_vocabulary(), end=2).collect()}
    assert [got[i] for i in range(len(texts))] == [[*i, 2] for i in library(texts)]
    pieces = stock.pieces(stock.encoded(odd.withColumnRenamed("fp", "ids"), queries.word_vocabulary(), end=2)).collect()
    total = sum(len(i) + 1 for i in library([r.text for r in odd.collect()]))
    assert sum(p.length for p in pieces) == total
    assert stock.pieces(stock.encoded(none, queries.word_vocabulary(), end=2)).count() == 0
    named = spark.createDataFrame([("a", [1, 2]), ("a", [1, 2]), (None, [3]), ("b", None)], "doc_id string, ids array<int>")
    sizes = {}
    for p in stock.pack(named).collect():
        sizes[p.doc_id] = sizes.get(p.doc_id, 0) + p.length
    assert sizes == {"a": 4, None: 1}


def test_full_cache(monkeypatch, rng):
    from volumetry.llm import wordbatch

    monkeypatch.setattr(wordbatch, "CACHE", 50)
    with open(queries.word_vocabulary(), encoding="utf-8") as f:
        made = wordbatch.Batch(f.read())
    for _ in range(5):
        texts = [prose(rng, 200) for _ in range(3)]
        assert [np.frombuffer(a, "<i4").tolist() for a in made.encode_all(texts)] == library(texts)
