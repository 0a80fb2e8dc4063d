from pyspark.sql import functions as F

import corpus_pipeline
from volumetry.llm import near, simhash


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stage_finds_every_pair_of_similar_texts(spark, data):
    """Brute force over all pairs: five words, 0.8."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    group = {i: {i} for i in texts}
    for i, a in texts.items():
        for j, b in texts.items():
            if i < j and (a == b or len(a & b) >= 0.8 * len(a | b)) and group[i] is not group[j]:
                group[i] |= group[j]
                for k in group[j]:
                    group[k] = group[i]
    want = {min(g) for g in group.values()}
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, data).collect()]
    assert sorted(got) == sorted(want)


def test_copies_beyond_the_bits_of_op8(spark, rng):
    words = [[f"w{rng.randrange(10**6)}" for _ in range(300)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)]
    for i, w in enumerate(words):  # 5 words of 300 replaced: about 0.84
        rows.append((100 + i, " ".join("x" if k % 60 == 30 else x for k, x in enumerate(w))))
        rows.append((200 + i, " ".join("y" if k % 20 == 10 else x for k, x in enumerate(w))))  # about 0.6, stays
    prints = {i: simhash.fingerprint(t.encode()) & (2**64 - 1) for i, t in rows}
    assert sum((prints[i] ^ prints[100 + i]).bit_count() > 4 for i in range(40)) > 20
    kept = {r.doc_id for r in near.one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {*range(40), *range(200, 240)}


def test_large_group_and_odd_rows(spark, odd, none, rng):
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*base[:i], "other", *base[i + 1:]])) for i in range(300)]
    assert [r.doc_id for r in near.one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]
    assert near.one_each(none).count() == 0
    out = near.one_each(odd).collect()
    assert {r.doc_id for r in out} == {1, 3, 6, 7, 8} and len(out) == 5


def test_long_lists_in_blocks(spark, rng, monkeypatch):
    """Families around a base that is not there: rows link in twos and threes, some rows to none."""
    monkeypatch.setattr(near, "FEW", 4)
    monkeypatch.setattr(near, "BLOCK", 40)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for f in range(30):
        own = [f"f{f}x{k}" if k % 25 == f % 25 else w for k, w in enumerate(base)]  # about 0.5 between families
        for m in range(rng.randint(1, 5)):
            w = list(own)
            w[rng.randrange(300)] = f"m{f}x{m}"
            rows.append((len(rows), " ".join(w)))
    sets = {i: shingle_set(t) for i, t in rows}
    group = {i: {i} for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and len(a & b) >= 0.8 * len(a | b) and group[i] is not group[j]:
                group[i] |= group[j]
                for k in group[j]:
                    group[k] = group[i]
    got = [r.doc_id for r in near.one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted({min(g) for g in group.values()})


def test_columns_stay(spark):
    rows = [(1, "a b c d e f", 7, 1), (2, "a b c d e f", 8, 2), (2, "x", 9, 3), (2, "x", 9, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark long, _mark long")
    for keep in (near.one_each, simhash.one_each):
        assert sorted(tuple(r) for r in keep(docs).collect()) == [rows[0], rows[2]]


def test_simhash_links_come_first(spark, rng, monkeypatch):
    """Without any band, copies within the bits of SimHash still go; texts of close fingerprints that differ stay."""
    monkeypatch.setattr(near, "bands", lambda low: [])
    rows = []
    for i in range(20):
        w = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows += [(i, " ".join(w)), (100 + i, " ".join(w[:-1]))]
    prints = {i: near.fingerprint(near.shingles(t.encode())) & (2**64 - 1) for i, t in rows}
    near_bits = {i for i in range(20) if (prints[i] ^ prints[100 + i]).bit_count() <= 4}
    assert len(near_bits) > 15
    rows += [(200, "a b c d e"), (201, "a b c d f"), (202, None), (203, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    named = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), "text")
    made = near.keyed(docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark")).alias("_row"), "text"), "text", ["_row"])
    keys = {r["key"]: r["_row"]["id"] for r in made.where("_row.id < 200").collect()}
    assert {min(keys[r.u], keys[r.v]) for r in near.close(named, made.where("_row.id < 200")).collect()} == near_bits
    kept = {r.doc_id for r in near.one_each(docs).collect()}
    assert kept == {*range(20), *(100 + i for i in range(20) if i not in near_bits), 200, 201, 202}


def test_texts_of_no_pair_are_not_moved(spark, rng, monkeypatch):
    rows = [(i, i * 7, f"t{i}") for i in range(3000)] + [(None, 5, "n"), (None, 5, "n"), (4, 28, "t4")]
    texts = spark.createDataFrame(rows, "id long, mark long, text string")
    sides = spark.createDataFrame([(4, 28), (None, 5), (2999, 2999 * 7)], "i long, m long")
    got = [tuple(r) for r in near.sieved(texts, sides).collect()]
    want = [(4, 28, "t4"), (4, 28, "t4"), (None, 5, "n"), (None, 5, "n"), (2999, 2999 * 7, "t2999")]
    assert all(got.count(r) == want.count(r) for r in want) and len(got) < 600
    assert near.sieved(texts, sides.limit(0)).count() == 0
    monkeypatch.setattr(near, "SLOTS", 1)  # no room to tell rows apart
    assert near.sieved(texts, sides).count() == len(rows)


def twins(rng, n):
    """Texts of 0.71 and more to each other (five words of 300 are others), and to each of them a twin of 0.82, which has
    two of the five, too."""
    base, rows = [f"w{i}" for i in range(300)], []
    for i in range(n):
        places = [8 + 36 * k + rng.randrange(24) for k in rng.sample(range(8), 8)]
        for side in (2, 5):
            new = {**{at: f"x{i}" for at in places[:2]}, **{at: f"y{i}" for at in places[side:side + 3]}}
            rows.append((len(rows), " ".join(new.get(k, w) for k, w in enumerate(base))))
    return rows


def least_ids(rows):
    """The smallest id of each class, by brute force over all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    group = {i: {i} for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and group[i] is not group[j] and (a == b or len(a & b) >= 0.8 * len(a | b)):
                group[i] |= group[j]
                for k in group[j]:
                    group[k] = group[i]
    return sorted({min(g) for g in group.values()})


def test_many_partners_that_look_alike(spark, rng, monkeypatch):
    """Rows of long lists with more likely partners than they name: none of their pairs is left out."""
    rows = twins(rng, 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = least_ids(rows)
    assert sorted(r.doc_id for r in near.one_each(docs).collect()) == want
    monkeypatch.setattr(near, "BLOCK", 20)
    monkeypatch.setattr(near, "HELD", 3000)
    assert sorted(r.doc_id for r in near.one_each(docs.union(docs)).collect()) == want
