import random

import pytest

from volumetry.llm import rules


def rows_of(spark, rows):
    plain = dict.fromkeys(rules.FEATURES, 0.0)
    made = [{"doc_id": i, "_good": good, **plain, "n_words": 100, **values} for i, (good, values) in enumerate(rows)]
    schema = "doc_id long, _good int, " + ", ".join(f"{f} {'long' if f == 'n_words' else 'double'}" for f in rules.FEATURES)
    return spark.createDataFrame([tuple(r[c] for c in ["doc_id", "_good", *rules.FEATURES]) for r in made], schema)


def rejected(rows, learned):
    hit = lambda v, c: (v.get(c.feature, 0.0) > c.cut) == c.above
    return {i for i, (_, v) in enumerate(rows) if any(all(hit({"n_words": 100, **v}, c) for c in r) for r in learned)}


@pytest.mark.parametrize("n_bad", [30, 100])
def test_rare_kind(spark, n_bad):
    """0.5 to 2 % of the rows, inside the top bin of equal counts."""
    r = random.Random(1)
    rows = [(1, {"digit_share": r.uniform(0, 0.4)}) for _ in range(6000 - n_bad)] + [(0, {"digit_share": r.uniform(0.6, 0.9)}) for _ in range(n_bad)]
    out = rejected(rows, rules.fit(rows_of(spark, rows)))
    assert out and min(out) >= 6000 - n_bad and len(out) > 0.9 * n_bad


def test_imprecise_rule_does_not_end_the_list(spark):
    r = random.Random(2)
    rows = [(1, {"digit_share": r.uniform(0, 0.4)}) for _ in range(2000)] + [(i % 2, {"symbol_share": r.uniform(0.5, 1)}) for i in range(300)]
    rows += [(0, {"digit_share": r.uniform(0.6, 0.9)}) for _ in range(60)]
    out = rejected(rows, rules.fit(rows_of(spark, rows)))
    assert len([i for i in out if i >= 2300]) > 54 and len([i for i in out if i < 2000]) == 0


def test_columns_of_any_name_stay(spark):
    from volumetry.llm import rules

    docs = spark.createDataFrame([(1, "a b a b", 7, 8, "x")], "doc_id long, text string, _words long, _lines long, n_words string")
    row = rules.with_statistics(docs).first()
    assert (row._words, row._lines, row.n_words) == (7, 8, 4)
    assert rules.judged(docs, []).first()._words == 7
