import random

import numpy as np
import pytest

from tests.llm.conftest import prose
from volumetry.llm import secret

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def keys(n, count, of=LETTERS + "0123456789"):
    r = random.Random(n)
    return ["".join(r.choice(of) for _ in range(n)) for _ in range(count)]


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(4)
    rows = [(i, f"{prose(r, 40)} password={k}") for i, k in enumerate(keys(30, 300))]
    return secret.train(spark.createDataFrame(rows, "doc_id long, text string"))


def test_what_is_left_beside_a_pattern(model):
    for key in keys(40, 50):
        for text, at in ((f"1234567890123456789-{key}", 20), (f"{key}-1234567890123456789", 0)):
            found = secret.spans(text, model)
            assert (at, at + 40, "markov") in found and len(found) == 2
            assert key not in secret.redact(text, model)
    assert [k for _, _, k in secret.spans("1234567890123456789-kalobade", model)] == ["hex"]


def test_runs_without_digits(model):
    assert np.mean([bool(secret.spans(k, model)) for k in keys(24, 200, LETTERS)]) > 0.95
    assert secret.spans("kalobademanoromalube", model) == []


def test_ordinary_identifiers(spark, data):
    """Both error rates of the model of the registered tables, on strings that are not in them."""
    own = secret.train(spark.read.parquet(f"{data}/documents.parquet"))
    for name in ("customer_account_id_v2", "http_response_code_404", "2024-01-15T10-30-00Z", "/articles/2024/06/how-to-cook", "getUserNameById2",
                 "max_connection_retry_count", "src/components/Header2", "IllegalArgumentException", "DEFAULT_TIMEOUT_SECONDS", "2023/11/05/annual-report"):
        assert secret.spans(f"see {name} there", own) == [], name
    assert np.mean([not secret.spans(k, own) for n in (16, 20, 40) for k in keys(n, 300)]) < 0.02


def test_second_sample():
    found = secret.ordinary("the old house 2024-01-15 10.0.0.1 " + "x7Kp2mQ9vL4nR8sT " + "a new red car", ["api_key"])
    assert {"2024-01-15", "10.0.0.1", "api_key", "house"} <= set(found) and not any("x7Kp" in w for w in found)
    assert any("_" in w for w in found if w != "api_key") and any(c.isdigit() for w in found for c in w if "/" in w or "_" in w or "-" in w)
    assert np.concatenate([secret.steps(w) for w in found]).tolist() == secret.many_steps(found).tolist()
