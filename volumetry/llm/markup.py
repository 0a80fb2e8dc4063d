"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. Parts that never hold article text (scripts, styles,
menus, headers and footers of the page, sidebars, adverts, notices, comments of readers, known by
tag or by the words of class, id and role) are left out with all they contain, and so are forms, unless a
form is wrapped around a marked article or, on a page without a mark, around most words.

First pass: each block is decided by its length, the share of its text inside links and the share of stop
words. Blocks that are mostly links are bad; dense in stop words, good; headings, short blocks and those
between the limits stay open. The mark of an article (``article``, ``main``, an article role) is one more feature: beside
a marked part blocks are bad, inside it a single block of links stays open and only lists of links are bad. Where a page
has hardly any known stop word, length and links decide alone. Second pass: an open block takes the label
of its nearest decided neighbours. Where they differ, the nearer one counts; at equal distance the one below a
heading, and bad otherwise. The edge of a page is a bad neighbour of blocks that have no decided one in the same
part. Inside a mark a block is bad only between bad ones.

Stop words are learned (``learn``): words that are in ``COMMON`` or more of the long blocks of pages of one language
(the page's own ``lang``), counted over all pages. To them comes a short list for pages without one.

Character references are decoded, white space inside a block becomes one space, blocks are joined in
page order by an empty line. Null or empty pages give an empty text, and an empty table no rows and no stop words.
Unclosed tags end with the part they are in; a page may end anywhere. Time grows with the length of a page,
however deep its tags are. Repeated rows are rows like any other; an input column with the name of a result is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volumetry.llm.batches import add_columns, pieces
from volumetry.session import cut_lineage

SKIP = {"script", "style", "noscript", "template", "head", "svg", "math", "iframe", "object", "button", "select",
        "textarea", "nav", "footer", "aside", "dialog", "menu", "canvas", "video", "audio"}
RAW = {"script", "style", "textarea", "title"}  # text up to their end tag is no markup
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "blockquote", "body", "br", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
         "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "search",
         "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "head", "form", "nav", "footer", "aside", "dialog", "menu"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# names of parts beside the article, as whole words of class, id, role or aria-label
BESIDE = re.compile(
    r"(?:^|(?<!\bhas)(?<!\bno)(?<!\bwith)[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|captcha|comments?|consent|contentinfo|cookies?|disqus|footer|gdpr|"
    r"login|menu|modal|nav\w*|newsletter|notices?|overlay|pagination|popup|promo\w*|related|repl(?:y|ies)|share|sharing|"
    r"sidebar\w*|signup|social|sponsor\w*|subscribe|tags|toolbar|widget\w*)(?:$|[\s_-])", re.I)
# the same on a page, but not inside an article, nor as the head of one
ABOVE = re.compile(r"(?:^|(?<!\barticle)(?<!\bcontent)(?<!\bentry)(?<!\bhas)(?<!\bno)(?<!\bpost)(?<!\bstory)(?<!\bwith)[\s_-])"
                   r"(?:header|masthead|search)(?:$|[\s_-])", re.I)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|main|entry-content|post-content|article-body|story)(?:$|[\s_-])", re.I)
TAG = re.compile(r"<(?:!--.*?(?:-->|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$))", re.S)
NAMES = re.compile(r"\b(class|id|role|aria-label|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
# the commonest small words of English, German, French and Spanish, for pages whose language has not been learned
STOP = frozenset(
    "the of and to in a is that it for on was be with as by this are from at an or not have but his they which you he "
    "der die das und ist von mit den zu ein eine im nicht des dem auf für sich auch als an es "
    "le la les de des du et en un une que qui dans pour pas sur est au par plus ce avec "
    "el los las del y que en una por con para es se no al lo su como más".split())

LONG, SHORT = 25, 10  # words
LINKS = 0.5
STOPS = 0.12
COMMON = 0.3  # share of the long blocks of a language that hold a stop word, at least
ENOUGH = 20  # long blocks of a language to learn from
HELD_WORDS = 300_000  # different words that a task counts before it sends them on
GOOD, BAD, OPEN = 1, 0, 2


class Block(NamedTuple):
    text: str
    words: int
    links: float  # share of the words
    inside: bool  # of a marked article
    heading: bool
    part: int  # number of the tag around it
    form: bool


class Open(NamedTuple):
    name: str
    skipped: bool
    inside: bool
    form: bool
    number: int
    block: int  # depth of the innermost block-level tag
    heading: bool


def blocks(html: str) -> list[Block]:
    """The blocks outside the skipped parts, in page order."""
    made: list[Block] = []
    root = Open("", False, False, False, 0, 0, False)
    stack, depths, tags = [root], {}, 0  # depths of the open tags by name
    links, linked, at, size = 0, 0, 0, len(html)
    parts: list[str] = []
    first = root  # where the block begins

    def add(text: str) -> None:
        nonlocal first, linked
        top = stack[-1]
        if top.skipped or not text:
            return
        if not parts:
            first = top
        parts.append(text)
        if links:
            linked += len(text.split())

    def finish() -> None:
        nonlocal linked
        words = unescape("".join(parts)).split()
        if words:
            around = stack[0] if first.block == 0 else first
            made.append(Block(" ".join(words), len(words), linked / len(words), first.inside, first.heading, around.number, first.form))
        parts.clear()
        linked = 0

    def leave(depth: int) -> None:
        while len(stack) > depth:
            depths[stack.pop().name].pop()

    while at < size:
        m = TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            finish()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            # the end of a tag inside a line doesn't end a block
            if depths.get(name) and (name in BLOCK or name in SKIP or depths[name][-1] > stack[-1].block):
                leave(depths[name][-1])
            continue
        if name in VOID:
            continue
        if name in RAW:  # straight to the end tag
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if name in BLOCK and depths.get("p") and depths["p"][-1] == stack[-1].block:  # a block ends an open paragraph
            leave(depths["p"][-1])
        if name == "li" and depths.get("li") and depths["li"][-1] == stack[-1].block:
            leave(depths["li"][-1])
        top = stack[-1]
        said = {k.lower(): a or b or c for k, a, b, c in NAMES.findall(m[3])} if m[3] else {}
        labels = " ".join(v for k, v in said.items() if k != "hidden")
        page = name in ("body", "html")
        marked = name in ("article", "main") or (not page and bool(ARTICLE.search(labels)))
        beside = name in SKIP or "hidden" in said or not (page or name in ("article", "main")) and bool(BESIDE.search(labels))
        if not top.inside and not marked and not page:
            beside = beside or name == "header" or bool(ABOVE.search(labels))
        if name == "form" and top.inside:
            beside = True
        if name == "a":
            links += 1
        elif name in BLOCK:
            links = 0
        skipped = top.skipped or beside
        inside = top.inside or (marked and not skipped)
        tags += 1
        depths.setdefault(name, []).append(len(stack))
        block = name in BLOCK
        # blocks know the part around them, so the number is that of the parent of their own tag
        number = top.number if name in ("p", "li") or name in HEADINGS or not block else tags
        stack.append(Open(name, skipped, inside, (top.form or name == "form") and not inside, number, len(stack) if block else top.block,
                          name in HEADINGS or (top.heading and not block)))
    finish()
    return made


def candidates(html: str) -> list[Block]:
    """The blocks of a page without those of forms; of a page without a mark with them, if they hold most words."""
    found = blocks(html)
    if any(b.form for b in found):
        total, held = sum(b.words for b in found), sum(b.words for b in found if b.form)
        if any(b.inside for b in found) or 2 * held <= total:
            found = [b for b in found if not b.form]
    return found


def stop_words(text: str, stops: frozenset) -> int:
    return sum(map(stops.__contains__, LETTERS.findall(text.lower())))


def first_pass(found: list[Block], stops: frozenset) -> list[int]:
    """Good, bad, or open, for each block."""
    marked = any(b.inside for b in found)
    dense = [0.0 if b.links > LINKS else stop_words(b.text, stops) / b.words for b in found]
    prose = [(b.words, d) for b, d in zip(found, dense) if b.links <= LINKS]
    known = sum(n * d for n, d in prose) >= STOPS / 4 * sum(n for n, _ in prose)
    out = []
    for i, b in enumerate(found):
        if marked and not b.inside:
            label = BAD
        elif b.links > LINKS:
            beside = [found[k].links > LINKS for k in (i - 1, i + 1) if 0 <= k < len(found)]
            label = OPEN if b.inside and not any(beside) else BAD
        elif b.heading or b.words < SHORT:
            label = OPEN
        elif dense[i] >= STOPS or b.words >= LONG and (dense[i] >= STOPS / 2 or not known):
            label = GOOD
        else:
            label = BAD if b.words >= LONG and not b.inside else OPEN
        out.append(label)
    return out


def second_pass(found: list[Block], labels: list[int]) -> list[bool]:
    """Open blocks take the label of the nearest decided ones, as told at the top."""
    n = len(labels)
    before, after, last = [-1] * n, [n] * n, -1
    for i in range(n):
        last = i if labels[i] != OPEN else last
        before[i] = last
    last = n
    for i in reversed(range(n)):
        last = i if labels[i] != OPEN else last
        after[i] = last
    out = []
    for i, b in enumerate(found):
        p, q = before[i], after[i]
        sides = [labels[k] if 0 <= k < n else None for k in (p, q)]
        if labels[i] != OPEN:
            good = labels[i] == GOOD
        elif b.inside:
            good = GOOD in sides or sides == [None, None]
        elif None in sides:
            k = q if sides[0] is None else p
            good = 0 <= k < n and labels[k] == GOOD and (found[k].part == b.part or b.heading and k == q)
        elif sides[0] == sides[1]:
            good = sides[0] == GOOD
        elif i - p != q - i:
            good = sides[i - p > q - i] == GOOD
        else:
            good = b.heading and sides[1] == GOOD
        out.append(good)
    return out


def language(html: str) -> str:
    """The language a page names in its first tags, or an empty string."""
    m = LANG.search(html, 0, 2048)
    return m[1].lower() if m else ""


def main_text(html: str | None, learned: Mapping[str, frozenset] | None = None) -> str:
    if not html:
        return ""
    found = candidates(html)
    stops = STOP | (learned or {}).get(language(html), frozenset())
    keep = second_pass(found, first_pass(found, stops))
    return "\n\n".join(b.text for b, good in zip(found, keep) if good)


def learn(df: DataFrame, html: str = "html") -> dict[str, frozenset]:
    """Stop words by language: those in ``COMMON`` or more of all its long blocks that are no links. A language has at
    most the mean number of different words in a block, divided by ``COMMON``."""
    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()),
                                               pa.array(list(held.values()), pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for piece in pieces(batch, "html"):
                for page in piece.column("html").to_pylist():
                    if not page:
                        continue
                    name = language(page)
                    for b in candidates(page):
                        if b.words >= LONG and b.links <= LINKS:
                            held.update((name, w) for w in {"", *LETTERS.findall(b.text.lower())})  # the empty word counts blocks
                    if len(held) > HELD_WORDS:
                        yield out()
                        held.clear()
        yield out()

    counted = df.select(F.col(html).alias("html")).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted, "words")
    totals = counted.where((F.col("word") == "") & (F.col("n") >= ENOUGH)).select("lang", F.col("n").alias("total"))  # at most 26^2 + 26^3 + 1 rows
    common = counted.where("word != ''").join(F.broadcast(totals), "lang").where(F.col("n") >= COMMON * F.col("total"))
    found = common.groupBy("lang").agg(F.collect_list("word").alias("words")).toArrow().to_pydict()
    return {name: frozenset(words) for name, words in zip(found["lang"], found["words"])}


def extract(df: DataFrame, html: str = "html", out: str = "text", keep: list[str] | None = None,
            learned: Mapping[str, frozenset] | None = None) -> DataFrame:
    """Adds the main text of each page, by the stop words ``learned`` (or the short list alone)."""
    def run(pages: list) -> list[pa.Array]:
        return [pa.array([main_text(p, learned) for p in pages], pa.string())]

    return add_columns(df, html, [T.StructField(out, T.StringType())], run, keep)
