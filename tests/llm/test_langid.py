"""Languages that are rare in the labelled rows, and predictions against plain sums."""

import math

import numpy as np
import pytest

from volumetry.llm import langid


def many(rng, letters, n):
    return [" ".join("".join(rng.choice(list(letters), 5)) for _ in range(30)) for _ in range(n)]


def test_a_rare_language_is_learned(spark):
    rng = np.random.default_rng(3)
    rows = [(t, "aa") for t in many(rng, "abcdefg", 3000)] + [(t, "bb") for t in many(rng, "hijklmn", 3000)] + [(t, "zz") for t in many(rng, "opqrstu", 3)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), sample=100)
    assert model.languages == ["aa", "bb", "zz"]
    assert {model.predict(t)[0] for t in many(rng, "opqrstu", 20)} == {"zz"} and {model.predict(t)[0] for t in many(rng, "hijklmn", 20)} == {"bb"}


def test_predictions_are_plain_sums(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs)
    rows = langid.predict(docs.withColumns({"score": docs["doc_id"], "lang_pred": docs["lang"]}), model).collect()
    for r in rows:
        if not r.text or not langid.LETTER.search(r.text):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
            continue
        c = [ord(x) for x in f" {r.text.lower()} "]
        two = [(a * 2654435761 + b * 40503) % 2**32 for a, b in zip(c, c[1:])]
        at = [x >> 17 for x in two] + [((x * 31 + b * 2246822519) % 2**32) >> 17 for x, b in zip(two, c[2:])]
        logits = [(math.fsum(float(model.table[i, k]) for i in at) / len(at) + float(model.bias[k])) / model.temperature for k in range(len(model.languages))]
        p = [math.exp(x - max(logits)) for x in logits]
        best = p.index(max(p))
        assert r.lang_pred == model.languages[best] and r.score == pytest.approx(p[best] / sum(p), abs=1e-6)
        assert r.accepted == (r.score >= model.least)
