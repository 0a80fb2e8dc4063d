"""The model doesn't depend on the partitions of its input, and its tables grow with it."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from volumetry.llm import maxent


def held_out(spark, docs, parts):
    mine = docs.repartition(parts, "doc_id").sortWithinPartitions("text") if parts > 1 else docs.coalesce(1)
    _, out = maxent.fit_and_score(mine.where("doc_id % 5 != 1"), mine.where("doc_id % 5 = 1"))
    rows = out.collect()
    n = sum(r.n_tokens for r in rows)
    return sum(r.score for r in rows) / n, sum(r.base_score for r in rows) / n


def test_partitions_do_not_matter(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    one, base = held_out(spark, docs, 1)
    many, _ = held_out(spark, docs, 40)
    assert abs(one - many) < 1e-4 and one > base + 0.02


def test_shards_and_sparse_counts(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    whole, _ = maxent.prepare(docs, maxent.word_counts(docs))
    monkeypatch.setattr(maxent, "CELLS", 500)  # more cells than a task holds
    monkeypatch.setattr(maxent, "SHARD", 5_000)
    monkeypatch.setattr(maxent, "BITS", 6)
    monkeypatch.setattr(maxent, "BUCKETS_A_ROOT", 0.1)
    model = maxent.train_model(docs, maxent.word_counts(docs))
    assert model.weights.shape == (64, maxent.CLASSES + 1) and (model.classes == whole.classes).all()
    again = maxent.train_model(docs.repartition(9), maxent.word_counts(docs))
    assert np.allclose(model.weights, again.weights, atol=1e-5) and np.allclose(model.inside, again.inside)


def test_tables_grow():
    assert maxent.sizes(0) == maxent.sizes(10**6) == (maxent.KNOWN, maxent.BITS)
    (a, b), (c, d) = maxent.sizes(10**9), maxent.sizes(10**11)
    assert c >= 9 * a > 9 * maxent.KNOWN and d > b > maxent.BITS


def test_words_inside_a_class_are_learned(spark, rng):
    """Of 300 pairs of words the second follows from the first; shares after a class would leave -1.3 for it at best."""
    texts = [(i, " ".join(f"l{k} r{k}" for k in (rng.randrange(300) for _ in range(50)))) for i in range(3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    _, out = maxent.fit_and_score(docs.where("doc_id % 5 != 1"), docs.where("doc_id % 5 = 1"))
    rows = out.collect()
    assert sum(r.score for r in rows) / sum(r.n_tokens for r in rows) > -1.7


def test_leaves_of_a_tree_share_one(rng):
    n = 700
    classes = np.array([0] + [rng.choice([1, 1, 1, 2, 3]) for _ in range(n)] + [4])
    counts = np.array([0.0] + [float(rng.randint(3, 10**rng.randint(1, 6))) for _ in range(n + 1)])
    route, turn, shares = maxent.trees(classes, counts)
    noise = np.random.default_rng(1).normal(size=shares.shape)
    for table in (shares, shares + noise):
        logs = table - np.log(np.exp(table).sum(axis=1, keepdims=True))
        leaf = np.where(route >= 0, logs[route, turn], 0.0).sum(axis=0)
        for g in range(1, 5):
            assert abs(np.exp(leaf[classes == g]).sum() - 1) < 1e-9
        if table is shares:
            mine = classes == 1
            assert np.allclose(np.exp(leaf[mine]), (counts[mine] + 0.5) / (counts[mine] + 0.5).sum())
    assert maxent.trees(np.zeros(1, "int64"), np.zeros(1))[0].shape == (0, 1)


def test_softmax_without_a_shift():
    x = np.random.default_rng(2).normal(scale=9.0, size=(500, 16)).astype("float32")
    x[:, 3] = -1e9  # no such child
    shift, e, total = maxent.softmax_parts(x)
    assert not shift.any()  # these rows need no largest value
    for rows in (x, x + 200, x - 200, np.vstack([x, x[:1] - 300])):
        wide = rows.astype("float64")
        want = wide - np.log(np.exp(wide - wide.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - wide.max(axis=1, keepdims=True)
        assert np.allclose(maxent.log_share(rows, np.full(len(rows), 5)), want[:, 5], atol=1e-3)
    assert len(maxent.softmax_parts(x[:0])[2]) == 0


def test_steps_move_whole_rows():
    r = np.random.default_rng(3)
    for kind, columns in (("f4", 16), ("f8", 16), ("f4", 5)):
        table, logits = r.normal(size=(40, columns)).astype(kind), r.normal(size=(300, columns)).astype(kind)
        features, target = [r.integers(0, n, 300) for n in (40, 7)], r.integers(0, columns, 300)
        assert np.array_equal(maxent.rows_at(table, features[0]), table[features[0]])
        want = table.astype("f8")
        grad = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True) - np.eye(columns)[target]
        for f in features:
            sums = np.zeros_like(want)
            np.add.at(sums, f, grad)
            want -= sums * (0.8 / 4 / np.maximum(np.bincount(f, minlength=40), 1) ** 0.75)[:, None]
        got = maxent.descent(table, features, logits, target, 0.8, 0.75)
        assert np.allclose(table, want, atol=1e-4) and np.allclose(got, grad, atol=1e-5)


def test_places_of_other_words():
    known = np.array([True, False, False, True, True, False])
    assert [a.tolist() for a in maxent.unknown(known, np.array([0, 2, 4, 5]))] == [[1], [0], [], [0]]
    none = maxent.unknown(np.ones(3, bool), np.array([0, 1]))
    assert [a.tolist() for a in none] == [[], []]


def split(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", low)] + [maxent.END]


def test_different_words_of_many_texts():
    """Words of a piece are looked up once each, so its tokens are places among the different words."""
    every = "".join(f"x{chr(i)}" for i in range(128))
    texts = ["Ba be  bA", None, "", " \t\n", "be", " \x0b\x0cÀÉ ſ K\u212a 漢字\u00a0😀\x85\x1c ", every, "Ba\n", "\x00 a\x00"]
    for array in (pa.array(texts), pa.array(["left out", *texts, "too"]).slice(1, len(texts))):
        begins, codes, words = maxent.tokens(array)
        found = [words[c].as_py() for c in codes.tolist()]
        assert [found[a:b] for a, b in zip(begins.tolist(), [*begins.tolist()[1:], len(found)])] == [split(t) for t in texts]
        assert len(set(found)) == len(words)
    of = np.repeat(np.arange(len(texts)), np.diff(np.append(begins, len(codes))))
    some = (codes % 2 == 0) & (of != 2)
    want = [dict(Counter(w for w, k, s in zip(found, of.tolist(), some.tolist()) if s and k == i)) for i in range(len(texts))]
    where, word, n = maxent.tallied(of[some], codes[some], words)
    got = list(zip(where.tolist(), word.to_pylist(), n.tolist()))
    assert sorted(got) == sorted((i, w, k) for i, ws in enumerate(want) for w, k in ws.items())
    assert list(map(len, maxent.tallied(of[:0], codes[:0], words))) == [0, 0, 0]
    assert maxent.last_bytes(words).tolist() == [int.from_bytes(w[-2:]) for w in maxent.listed(words)]


def test_rows_in_order():
    r = np.random.default_rng(4)
    for top, n in ((70_000, 9000), (1 << 20, 9000), (5, 40), (1, 1), (1 << 16, 0)):  # keys of 31, 34, 9, 0 and 16 bits
        f = r.integers(0, top, n)
        at, by = maxent.in_order(f, top)
        want = np.argsort(f, kind="stable")
        assert np.array_equal(by, want) and np.array_equal(at, f[want])


def test_ways_are_those_of_the_routes():
    n = 900
    r = np.random.default_rng(5)
    classes, counts = np.append(0, r.integers(1, 4, n)), np.append(0.0, r.integers(3, 10**6, n))
    route, turn, shares = maxent.trees(classes, counts)
    model = maxent.Model({b"%d" % i: i for i in range(1, n + 1)}, classes, counts, 0, 0, 0, 0, 14, None, None, route, turn, None)
    ids, one = r.integers(1, n + 200, 3000), r.integers(0, 10**6, 3000)
    at, rows, turns = model.ways(ids, one, one % 16)
    want = [(i, node, turn[level, ids[i]]) for level in range(len(route)) for i in np.flatnonzero(ids <= n).tolist() if (node := int(route[level, ids[i]])) >= 0]
    assert list(zip(at.tolist(), (rows[2] - (1 << 15)).tolist(), turns.tolist())) == want
    assert rows[0].tolist() == [(node * 1_000_003 + int(one[i])) * 0x9E3779B1 + 4 * 0x85EBCA77 >> 17 & 0x7FFF for i, node, _ in want]
    assert rows[1].tolist() == [(node * maxent.FAN + int(one[i]) % 16) * 0x9E3779B1 + 5 * 0x85EBCA77 >> 17 & 0x7FFF for i, node, _ in want]


def test_tables_begin_at_a_cache_line():
    for rows in (1, 700):
        table = np.random.default_rng(6).normal(size=(rows, 16)).astype("f4")
        copy = maxent.lined_up(table)
        assert copy.ctypes.data % 64 == 0 and np.array_equal(copy, table) and not np.shares_memory(copy, table)
