"""Block rules on pages without marks, odd markup and learned stop words."""

import html
import re
import time

import pytest

from volumetry.llm import markup

LONG = ("The cat and the dog went to the park and it was a good day for all of them. " * 3).strip()


def test_pages_without_the_mark_give_the_same_text(spark, data):
    pages = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    learned = markup.learn(spark.read.parquet(f"{data}/pages.parquet"))
    pages = [p for p in pages if len(markup.main_text(p).split()) >= 25]  # a page of few words has no block to decide by
    same = [markup.main_text(p, learned) == markup.main_text(re.sub("</?article>", "", p), learned) for p in pages]
    assert len(same) >= 40 and sum(same) >= 0.97 * len(same)


def test_all_of_a_marked_article_stays(spark, data):
    for page in [r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()]:
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|br|h1)>", inside)]
        assert markup.main_text(page) == "\n\n".join(p for p in parts if p)


@pytest.mark.parametrize("page, text", [
    (f"<article><p>{LONG}</p><p><a href=x>read the story here</a></p><p>{LONG}</p></article>", f"{LONG}\n\nread the story here\n\n{LONG}"),
    (f"<article><p>{LONG}</p><ul><li><a href=x>one</a><li><a href=y>two</a></ul></article>", LONG),
    (f"<article><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p></article>", f"Title\n\n{LONG}"),
    (f"<body><div class=header>Site</div><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p></body>", f"Title\n\n{LONG}"),
    (f"<article><p>{LONG}</p><div class='search-results'><p>{LONG}</p></div></article>", f"{LONG}\n\n{LONG}"),
    (f"<body><form action=x><div><h1>Title</h1><p>{LONG}</p><input></div></form></body>", f"Title\n\n{LONG}"),
    (f"<form><article><p>{LONG}</p><form>Sign up now</form></article></form>", LONG),
    (f"<body><p>{LONG}</p><form><p>Your name and the address of the house in which you live now</p></form></body>", LONG),
    (f"<body class='has-sidebar'><div class='page has-sidebar'><p>{LONG}</p></div></body>", LONG),
    (f"<body><div><p>{LONG}</p><p>Be.</p></div><div>Legal</div></body>", f"{LONG}\n\nBe."),
    (f"<article><b>bold<p>{LONG}</b><p>end</p></article><p>{LONG}</p>", f"bold\n\n{LONG}\n\nend"),
    ("<div><p>" + "zug " * 30 + "</p></div>", ("zug " * 30).strip()),  # no stop word on the page
])
def test_blocks(page, text):
    assert markup.main_text(page) == text


@pytest.mark.parametrize("page", [lambda n: "<div>" * n + "</b>" * n, lambda n: "<b><div>" + "<i>" * n + "</b>" * n, lambda n: "<ul><li>x" * n])
def test_deep_pages_take_linear_time(page):
    start = time.time()
    markup.main_text(page(50_000))
    assert time.time() - start < 20


def test_stop_words_are_learned(spark):
    words = "ka " + " ".join(f"w{chr(97 + i)}" for i in range(26)) + " vu"
    rows = [(i, f"<html lang='xx-YY'><body><p>{words.replace('wc', 'q' + 'abcdefghij'[i % 10] * 3)}</p></body></html>") for i in range(25)]
    rows += [(99, None), (100, "")]
    learned = markup.learn(spark.createDataFrame(rows, "page_id long, html string").repartition(7))
    assert list(learned) == ["xx"] and {"ka", "vu"} <= learned["xx"] and not any(w.startswith("qa") for w in learned["xx"])
    page = "<html lang=xx><body><p>ka ba ta ma vu fa da sa ka lo vu</p><p>ba ta ma fa da sa lo ba ta ma fa</p></body></html>"
    assert markup.main_text(page, learned).startswith("ka ba") and markup.main_text(page) == ""


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, html string")
    assert markup.learn(none) == {} and markup.extract(none, learned={}).count() == 0
