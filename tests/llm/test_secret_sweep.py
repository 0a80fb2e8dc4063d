"""Parts of runs beside the spans of the patterns, in one sweep."""

import random
import time

from volumetry.llm import secret


def plain(text, start, end, base):
    """The parts of a run by marking every character."""
    if not any(s < end and start < e for s, e, _, _ in base):
        return [(start, end)]
    free = [not any(s <= i < e for s, e, _, _ in base) for i in range(start, end)] + [False]
    out, begin = [], None
    for i, ok in enumerate(free, start):
        if ok and begin is None:
            begin = i
        if not ok and begin is not None:
            part = text[begin:i]
            a = begin + len(part) - len(part.lstrip("+/_=-"))
            out.append((a, a + len(part.strip("+/_=-"))))
            begin = None
    return [(a, b) for a, b in out if b - a >= secret.REST]


def test_parts_by_marking():
    draw = random.Random(5)
    for _ in range(2000):
        text = "".join(draw.choice("ab1_-=") for _ in range(80))
        base = [(s, s + draw.randint(1, 20), draw.randint(0, 2), "") for s in (draw.randrange(70) for _ in range(draw.randint(0, 6)))]
        start = draw.randrange(40)
        end = start + draw.randint(16, 40)
        assert secret.left(text, start, end, secret.merged(base)) == plain(text, start, end, base)


def test_many_spans_take_linear_time(spark):
    model = secret.train(spark.createDataFrame([(1, "plain words and names"), (2, "token=Zx81kqPw02Lm93Ab")], "doc_id long, text string"))
    text = "".join(f"token=Zx81kqPw02Lm{i:06d}-key\n" for i in range(64_000))
    start = time.time()
    assert len(secret.spans(text, model)) >= 64_000
    assert time.time() - start < 30
