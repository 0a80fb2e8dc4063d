"""Ranked search against scores of every document and query."""

import math
import re
from collections import Counter

import pytest

from tests.llm.conftest import prose
from volumetry.llm import queries, ranked

SCHEMA = "doc_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, items, k):
    split = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n = sum(bool(s) for s in split)
    length = sum(map(len, split))
    df = Counter(w for s in split for w in set(s))
    tfs = [Counter(s) for s in split]
    out = []
    for item, text in items:
        rows = []
        for (doc, _), s, tf in zip(docs, split, tfs):
            score = 0
            for w in TERM.findall((text or "").translate(LOWER)):
                if w in tf:
                    m = 25 + 75 * len(s) * n // length
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m))
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(rows, key=lambda r: r[:3])[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k):
    got = ranked.search(spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(items, "item_id long, text string"), k).collect()
    return sorted([tuple(r) for r in got], key=str)


def test_every_score(spark, rng, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK", 2)
    monkeypatch.setattr(ranked, "SEEDS", 1)
    docs = [(i, prose(rng, rng.randint(0, 120))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(150)]  # copies: equal scores by id
    items = [(i, prose(rng, rng.randint(1, 30))) for i in range(20)]
    items += [(50 + i, " ".join(docs[i * 9][1].split()[:15])) for i in range(10)] + [(70, "ba ba ba be BE"), (71, "zz"), (72, ""), (73, None)]
    assert found(spark, docs, items, 5) == brute(docs, items, 5)


@pytest.mark.parametrize("terms, count", [(10, 1000), (20_000, 3)])
def test_blocks_of_queries(spark, rng, monkeypatch, terms, count):
    monkeypatch.setattr(ranked, "TERMS", terms)
    monkeypatch.setattr(ranked, "QUERIES", count)
    docs = [(i, prose(rng, 40)) for i in range(60)]
    items = [(i, prose(rng, 8)) for i in range(7)]
    assert found(spark, docs, items, 4) == brute(docs, items, 4)


def test_odd_rows(spark, odd, none, rng):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, rows[0][1]), (1, rows[0][1]), (None, "more ba"), (2, "ÀÉ 漢字 x ſ"), (3, "x" * 50_000), (4, "!?")]
    queries_ = spark.createDataFrame(items, "item_id long, text string")
    got = sorted([tuple(r) for r in ranked.search(odd.withColumn("rank", odd.fp), queries_, 10).collect()], key=str)
    assert got == brute(rows, items, 10)
    assert ranked.search(none, queries_).count() == 0
    assert ranked.search(odd, queries_.where("false")).count() == 0


def test_blocks_are_skipped(spark, rng):
    """A summary bounds each score in its block, and most blocks of a planted passage's lists are left out."""
    docs = [(i, prose(rng, 100)) for i in range(600)]
    passage = prose(rng, 40)
    docs += [(1000 + i, f"{prose(rng, 10)} {passage} {prose(rng, 10)}") for i in range(12)]
    use = ranked.Queries([passage.encode()])
    df = spark.createDataFrame(docs, SCHEMA)
    vectors = ranked.vectors(df, use.words).collect()
    counts = Counter(t for r in vectors for t in r.ids)
    import numpy as np

    use.weigh(np.array([counts[t] for t in range(len(use.words))]), len(docs))
    best = np.full(len(use.words), 10**6)
    top = brute(docs, [(0, passage)], 10)[-1]
    kept = use.needed(best, np.array([min(s for _, _, _, s in brute(docs, [(0, passage)], 10))]))[0]
    assert 0 < len(kept) < len(use.terms[0]) and top[2] >= 1000
    assert min(counts[t] for t in set(use.terms[0].tolist()) - set(kept.tolist())) >= max(counts[t] for t in kept.tolist())


def test_query_over_all_items(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = queries.RUNS["op12_ranked_search"](spark, data).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(docs, items, 10)
