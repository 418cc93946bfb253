"""Main text of HTML pages by shallow block features and a small decision tree.

A page is cut into flat text blocks at block-level tags. A block is described
by its own and its neighbours' word count and link density, and by the kind of
container around it. A decision tree (CART, Gini), trained when needed on the
small labelled table below, says which blocks are main text.

Edge cases: null html and pages without main text give an empty string; text
of scripts, styles, forms and the like never becomes a block; unclosed and
unknown tags are tolerated (an unclosed script or style reaches to the end, as
in browsers, an unclosed menu or button only to the end of its tag); a tag cut off at the end of the page is dropped;
character references are decoded; repeated pages give repeated rows; other
input columns are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import small_batches, table

# Fixed values of the HTML standard: element kinds.
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_SKIPPED = set("script style noscript template textarea select button svg math iframe object canvas audio video title head".split())
_RAW = {"script", "style"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = set("div section article main nav header footer aside form ul ol dl table figure details dialog menu fieldset blockquote center body".split())
_BOILER_TAGS = set("nav header footer aside form dialog menu fieldset".split())
_MAIN_TAGS = {"article", "main"}
_BOILER_WORDS = set("ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice notices popup promo promotion related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split())

#: Words beside which a boiler word keeps its meaning, as in "site-footer" or "comment-list"; "related-work" is no notice.
_PLAIN_WORDS = set("area bar block bottom box col column container entry global group holder inner item items js left list listing links main module new outer page panel post primary reader right root row secondary section site slot sticky text top unit user wrap wrapper zone".split())

# a quote opens a value only after "=", and only if it is closed
_TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*)(?:>|$)""", re.S)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "main", "boiler")

#: Blocks seen in pages, as words, links (hundredths of the words), then the same of both neighbours.
_SHAPES = (
    (62, 0, 48, 0, 71, 0), (48, 0, 9, 0, 62, 0), (9, 0, 8, 0, 48, 0), (120, 4, 62, 0, 55, 0), (2, 0, 70, 0, 64, 0), (1, 0, 33, 0, 8, 0),
    (35, 12, 90, 0, 40, 5), (14, 0, 60, 0, 8, 0), (5, 100, 60, 0, 44, 0), (80, 0, 14, 0, 9, 0), (26, 0, 4, 100, 0, 0), (3, 0, 12, 0, 5, 0),
    (1, 100, 1, 100, 1, 100), (8, 0, 3, 100, 9, 0), (24, 0, 44, 0, 0, 0), (7, 60, 12, 0, 0, 0), (40, 30, 2, 0, 90, 0), (300, 0, 0, 0, 0, 0),
    (50, 0, 40, 0, 3, 100), (12, 0, 4, 100, 6, 100), (30, 20, 5, 100, 9, 80), (3, 100, 70, 0, 6, 100), (4, 0, 2, 100, 3, 60), (20, 75, 12, 60, 4, 100),
    (6, 80, 5, 100, 8, 60), (10, 10, 5, 100, 6, 50), (2, 0, 90, 0, 5, 100), (70, 0, 1, 100, 2, 50), (16, 50, 70, 0, 5, 100), (5, 0, 8, 0, 3, 0),
)
#: Blocks whose container says nothing, with a last 1 for main text: paragraphs at the start, inside and at the end of a text,
#: one alone, titles and short lines beside long ones; then menus, teasers, imprints and their neighbours.
_BARE = (
    (60, 0, 85, 0, 5, 0, 1), (48, 2, 70, 0, 0, 0, 1), (36, 0, 55, 3, 4, 100, 1), (25, 0, 62, 0, 3, 100, 1), (90, 4, 8, 0, 0, 0, 1), (55, 0, 0, 0, 0, 0, 1),
    (140, 0, 0, 0, 2, 100, 1), (30, 5, 0, 0, 0, 0, 1), (20, 0, 40, 0, 6, 90, 1), (65, 8, 5, 100, 7, 0, 1), (33, 0, 7, 0, 6, 0, 1), (6, 0, 3, 100, 70, 0, 1),
    (4, 0, 9, 90, 52, 0, 1), (9, 0, 2, 100, 38, 0, 1), (3, 0, 65, 0, 48, 0, 1), (13, 8, 45, 0, 6, 0, 1), (42, 15, 5, 0, 3, 100, 1), (28, 10, 35, 0, 5, 60, 1),
    (5, 0, 60, 0, 3, 100, 0), (6, 0, 75, 0, 0, 0, 0), (8, 25, 48, 0, 2, 100, 0), (4, 100, 60, 0, 0, 0, 0), (18, 60, 50, 0, 5, 100, 0), (35, 90, 40, 0, 3, 100, 0),
    (3, 0, 0, 0, 4, 100, 0), (7, 100, 0, 0, 45, 0, 0), (28, 55, 4, 100, 6, 100, 0), (6, 0, 5, 100, 8, 70, 0), (10, 0, 3, 100, 4, 0, 0), (60, 80, 6, 100, 9, 100, 0),
    (14, 0, 4, 100, 5, 100, 0), (12, 0, 3, 100, 6, 80, 0), (16, 0, 6, 100, 2, 100, 0), (13, 0, 70, 0, 4, 100, 1), (15, 0, 48, 0, 5, 100, 1), (17, 5, 62, 0, 0, 0, 1),
    (75, 0, 60, 0, 82, 0, 1), (58, 3, 11, 0, 75, 0, 1), (40, 0, 75, 0, 66, 2, 1), (92, 6, 40, 0, 12, 0, 1), (22, 0, 58, 0, 75, 0, 1), (31, 9, 66, 0, 70, 0, 1),
    (18, 0, 80, 0, 44, 0, 1), (11, 0, 64, 0, 75, 0, 1), (7, 0, 90, 0, 58, 0, 1), (150, 2, 6, 0, 20, 0, 1), (45, 0, 3, 100, 52, 0, 1), (52, 0, 45, 0, 9, 0, 1),
    (2, 100, 2, 100, 2, 100, 0), (4, 100, 3, 100, 5, 100, 0), (6, 80, 5, 100, 8, 60, 0), (3, 0, 2, 100, 4, 100, 0), (9, 45, 6, 80, 3, 100, 0), (4, 0, 0, 0, 2, 100, 0),
    (7, 0, 3, 100, 0, 0, 0), (12, 60, 7, 0, 10, 70, 0), (20, 75, 12, 60, 4, 100, 0), (10, 10, 5, 100, 6, 50, 0), (16, 50, 70, 0, 5, 100, 0), (5, 0, 8, 0, 3, 0, 0),
)
#: The labelled table: FEATURES, then 1 for main text. Inside an article every shape is main text
#: unless a menu, footer, notice, advert, side bar, form or comment holds it.
LABELLED = tuple((*x, main, boiler, int(main and not boiler)) for x in _SHAPES for main, boiler in ((1, 0), (0, 1), (1, 1))) + tuple((*x[:6], 0, 0, x[6]) for x in _BARE)


def train_tree(rows, depth: int = 8) -> tuple:
    """A CART tree: (feature, threshold, left, right) or a class; rows end in their class."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return (int(2 * ones > len(rows)),)

    def gini(part):
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for f in range(len(rows[0]) - 1):
        levels = sorted({r[f] for r in rows})
        for low, high in zip(levels, levels[1:]):
            at = (low + high) / 2
            score = gini([r for r in rows if r[f] <= at]) + gini([r for r in rows if r[f] > at])
            if best is None or score < best[0] - 1e-12:
                best = (score, f, at)
    if best is None or best[0] >= gini(rows) - 1e-12:
        return (int(2 * ones > len(rows)),)
    _, f, at = best
    return f, at, train_tree([r for r in rows if r[f] <= at], depth - 1), train_tree([r for r in rows if r[f] > at], depth - 1)


def classify(tree: tuple, row) -> int:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


@cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I)


def _says_boiler(attributes: str) -> bool:
    """Whether a class, id or role consists of boiler words, if need be beside plain ones."""
    for value in _ATTR.findall(attributes):
        for token in value.strip("\"'").split():
            words = {w for w in re.split(r"[^a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", token).lower()) if w}
            if not words.isdisjoint(_BOILER_WORDS) and words <= _BOILER_WORDS | _PLAIN_WORDS:
                return True
    return False


def blocks(page: str) -> Iterator[tuple[str, int, int, int, int]]:
    """The flat text blocks of a page: text, words, linked words, main, boiler."""
    stack: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = anchor = main = boiler = at = 0

    def flush():
        nonlocal linked
        words = "".join(parts).split()
        parts.clear()
        n, linked = linked, 0
        if words:
            yield " ".join(words), len(words), min(n, len(words)), int(main > 0), int(boiler > 0)

    def take(raw: str):
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if anchor:
                linked += len(text.split())

    while m := _TAG.search(page, at):
        take(page[at : m.start()])
        at = m.end()
        name = m[2] and m[2].lower()
        if not name:
            continue
        if name in _SKIPPED and not m[1]:
            closed = (m[3] or "").endswith("/")
            if name in _RAW or not closed:
                end = _end_of(name).search(page, at)
                # text of an unclosed script is script to the end; other unclosed elements are only a tag
                at = end.end() if end else len(page) if name in _RAW and not closed else at
            continue
        if name == "a":
            anchor = 0 if m[1] else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _INLINE:
            continue
        yield from flush()
        anchor = 0
        if name in _VOID or name not in _CONTAINERS:
            continue
        if m[1]:
            if any(x[0] == name for x in stack):
                while stack:
                    closed = stack.pop()
                    main -= closed[1]
                    boiler -= closed[2]
                    if closed[0] == name:
                        break
        else:
            # the header inside an article holds its title
            bad = int(name in _BOILER_TAGS and not (name == "header" and main) or name != "body" and _says_boiler(m[3] or ""))
            stack.append((name, int(name in _MAIN_TAGS), bad))
            main += stack[-1][1]
            boiler += bad
    take(page[at:])
    yield from flush()


def main_text(page: str, tree: tuple) -> str:
    """The blocks that the tree takes as main text, joined by an empty line."""
    found = list(blocks(page))
    share = [round(100 * b[2] / b[1]) for b in found]
    out = []
    for i, (text, words, _, main, boiler) in enumerate(found):
        before = (found[i - 1][1], share[i - 1]) if i else (0, 0)
        after = (found[i + 1][1], share[i + 1]) if i + 1 < len(found) else (0, 0)
        if classify(tree, (words, share[i], *before, *after, main, boiler)):
            out.append(text)
    return "\n\n".join(out)


def extract_text(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: key, url, text (empty if none), n_chars."""
    tree = train_tree(LABELLED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(x, tree) if x else "" for x in batch["_page"]]
            yield pd.DataFrame({"_key": batch["_key"], "_url": batch["_url"], "text": text})

    rows = df.select(F.col(key).cast("string").alias("_key"), F.col(url).alias("_url"), F.col(page).alias("_page"))
    out = small_batches(rows).mapInPandas(run, "_key string, _url string, text string")
    kind = df.schema[key].dataType
    return out.select(F.col("_key").cast(kind).alias(key), F.col("_url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
