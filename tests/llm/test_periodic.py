"""Periodic runs against brute force over all periods and places."""

import hashlib
import zlib

import pytest

from volumetry.llm import periodic, queries


def runs_of(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def test_random_words(rng):
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 10)):
            kinds, n = rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 1, 5, 6, 7, 40, 300, 700])
            w = [str(rng.randrange(kinds)) for _ in range(n)]
            if n > 8 and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + rng.randrange((n - a) // rng.randint(3, 10) + 1)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        sizes, runs, texts = periodic.periodic([" ".join(w).encode() for w in docs])
        assert sizes == [len(w) for w in docs]
        for w, r, t in zip(docs, runs, texts):
            want = runs_of(w)
            assert [tuple(x) for x in r.tolist()] == want
            assert t.decode() == " ".join(kept(w, want))


def test_nested_and_touching_runs():
    w = "a a a a a a b " * 4 + "b c " * 4 + "c d"
    _, (runs,), _ = periodic.periodic([w.encode()])
    assert [tuple(r) for r in runs.tolist()] == runs_of(w.split())
    assert (0, 28, 7) in runs_of(w.split())


def test_long_texts_in_chunks(monkeypatch):
    monkeypatch.setattr(periodic, "PLACES", 97)
    texts = [b"x " * 3000, " ".join(str(i % 701) for i in range(5000)).encode(), b"y"]
    _, runs, short = periodic.periodic(texts)
    assert [r.tolist() for r in runs] == [[[0, 3000, 1]], [[0, 5000, 701]], []]
    assert short[0] == b"x" and len(short[1].split()) == 701 and short[2] == b"y"


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = queries.RUNS["op11_periodic_runs"](spark, data).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in got}
    planted = 0
    for d in docs:
        w = (d.text or "").encode().split()
        h = zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            planted += 1
        runs = runs_of(w)
        r = by_id[d.doc_id]
        best = None
        for s, n, q in runs:
            if best is None or n * best[2] > best[1] * q:
                best = (s, n, q)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(w), len(runs), *want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(kept(w, runs))).hexdigest()
    assert planted > 5


@pytest.mark.parametrize("keep", [None, ["doc_id"]])
def test_odd_rows(spark, odd, none, keep):
    more = odd.withColumnRenamed("fp", "runs")
    out = periodic.with_runs(more, keep=keep)
    rows = out.collect()
    assert len(rows) == odd.count() and out.columns.count("runs") == 1
    empty = [r for r in rows if r.n_words == 0]
    assert empty and all(r.runs == [] and r.collapsed == "" for r in empty)
    assert periodic.with_runs(none).count() == 0
    assert queries.planted_repeats(none).count() == 0 and queries.planted_repeats(odd).count() == odd.count()
