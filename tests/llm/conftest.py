import random

import pytest

SYLLABLES = "ba be bi da de di ka ke ki lo lu ma mo na no ra ro sa so ta ti".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture()
def rng():
    return random.Random(5)


@pytest.fixture()
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and a clashing extra column."""
    r = random.Random(9)
    base = prose(r, 80)
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, None, None, None, None), (None, base + " more", "en", None, 2),
            (None, None, None, None, None), (4, "", "en", "b", 0), (5, " \t\n", "en", "b", 3), (6, prose(r, 30_000), "de", "b", 7), (7, "x" * 50_000, "de", "c", 1),
            (8, "ÀÉ ſ K 漢字 😀 " * 20, "fr", "c", 1)]
    return spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, fp int")


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
