import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near import shingle_set
from volumetry.llm import decontam, queries, rules, secret


def test_stages(spark, data):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    judged = {r.doc_id: r.kept for r in queries.RUNS["op2_rules"](spark, data).collect()}
    kept = {i for i, k in judged.items() if k}
    sets = {i: shingle_set(docs[i].text) for i in kept}
    groups = {i: {i} for i in sorted(kept)}
    for i in sorted(kept):
        for j in sorted(kept):
            a, b = sets[i], sets[j]
            if i < j and groups[i] is not groups[j] and (a == b or len(a & b) >= 0.8 * len(a | b)):
                groups[i] |= groups[j]
                for k in groups[j]:
                    groups[k] = groups[i]
    groups = {min(g) for g in groups.values()}
    bench = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower()) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + 10]) for w in bench for i in range(max(1, len(w) - 9)) if w}
    lower = {i: i + 32 for i in range(65, 91)}
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (docs[i].text or "").translate(lower)) for i in groups}
    want = {i for i, w in words.items() if not any(tuple(w[k:k + 10]) in windows for k in range(len(w)))}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, data).collect()}
    assert set(out) == want
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "simhash_dedup"


def test_each_stage_alone(spark, data, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd.drop("fp"), none):
            got = stage(spark, docs, data)
            if name != "bpe":
                assert got.columns == docs.columns
            got.collect()
    assert rules and decontam and secret


def test_fits_read_all_rows(spark, data, monkeypatch):
    """Rules and Markov models of the stages are learned on every labelled document and on every text."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model, labels = secret.train(docs), spark.read.parquet(f"{data}/labels.parquet").where("quality is not null")
    want = rules.labelled(docs, labels).collect()
    learned = []
    for module in (rules, secret):
        monkeypatch.setattr(module, "chosen", lambda *a: F.lit(False))
    monkeypatch.setattr(rules, "fit", lambda rows: learned.extend(rows.collect()) or [])
    corpus_pipeline.quality(spark, docs, data)
    assert sorted(map(str, learned)) == sorted(map(str, want)) and len(want) == labels.count() > 0
    monkeypatch.setattr(secret, "redacted", lambda df, model: learned.append(model) or df)
    corpus_pipeline.secrets(spark, docs, data)
    assert learned[-1].ratio == pytest.approx(model.ratio)
