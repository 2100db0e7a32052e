"""Operator 6: main text of HTML pages by flat text blocks and a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags.  Each block has its word count and link density,
those of the blocks before and after it, and what kind of element encloses it.  A decision tree, trained on the small
labelled table below, tells article blocks from the rest.  Kept blocks are joined in page order.

What an element's class or id says counts only where it is made up of such words alone, and not on elements that hold an
article or most of the page's text; a header inside an article belongs to it; lists of links and buttons inside an
article, and headings over them, are told by their own words and links and by those of their neighbours.

Defined cases: a null or empty page gives an empty text, as does one without article blocks; unclosed elements end with
the page or with the enclosing element, unclosed ones beside the article where one begins; text without any tag is one block; pages are taken whole at any length; repeated
rows each get a row; an empty table gives an empty result; extra columns are dropped.  Nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Comments, raw-text elements, declarations and tags.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|object|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, roles and words of class and id values that enclose what is not the article, and what marks the article.
ASIDE_TAGS = frozenset("nav header footer aside form button dialog menu fieldset".split())
FORMS = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of the page's words from which on a wrapper is no aside.
WRAPPER = 0.7
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
ASIDE_WORDS = (
    "cc ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion recommended related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets"
).split()
#: Words that may stand beside those in one class or id value and leave it what it is ("site-footer", "commentlist").
PLAIN_WORDS = "accept area bar block bottom box button buttons card col column container form global group icon icons info inner item items law left link links list main middle notification outer page panel pane policy posts primary reader readers right section secondary site slot thread top unit user users visitor visitors window wrap wrapper".split()
#: What readers say and other articles: such an element is never the article, even where articles stand in it.
OTHERS = frozenset("comment comments commentlist disqus replies respond related recommended".split())
MAIN_TAGS = frozenset("article main".split())
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: A value made up of such words alone, at least one of the first kind; others ("has-sidebar", "entry-header") say nothing.
_ANY = "|".join(sorted([*ASIDE_WORDS, *PLAIN_WORDS], key=len, reverse=True))
ASIDE_VALUE = re.compile(rf"(?:(?:{_ANY})[-_0-9]*)*(?:{'|'.join(sorted(ASIDE_WORDS, key=len, reverse=True))})[-_0-9]*(?:(?:{_ANY})[-_0-9]*)*", re.I)
LONGEST_VALUE = 48

#: Columns of the labelled table, and what the tree sees of them: ``place`` is 1 in an article element, 0 beside one, else 0.5.
TABLE = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "in_main", "in_aside", "heading", "has_main")
COLUMNS = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "place", "in_aside", "heading")
#: More words than these say nothing more.
ENOUGH = 16
#: Hand-labelled blocks (the last number is 1 for article text).
BLOCKS = (
    # menus, banners, comments, footers by their containers, with prose of any length among them
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 1, 0), (3, 1.0, 1, 1.0, 2, 1.0, 0, 1, 0, 1, 0), (14, 0.0, 2, 1.0, 9, 0.0, 0, 1, 0, 1, 0),
    (12, 0.2, 8, 0.0, 0, 0.0, 0, 1, 0, 1, 0), (18, 0.0, 4, 1.0, 4, 1.0, 0, 1, 0, 1, 0), (55, 0.0, 12, 0.0, 20, 0.0, 0, 1, 0, 1, 0),
    (33, 0.0, 2, 0.0, 5, 0.0, 0, 1, 1, 1, 0), (25, 0.0, 55, 0.0, 6, 0.0, 1, 1, 0, 1, 0), (70, 0.0, 25, 0.0, 44, 0.0, 1, 1, 0, 1, 0),
    (4, 0.5, 70, 0.0, 2, 1.0, 1, 1, 1, 1, 0), (12, 0.0, 61, 0.0, 20, 0.0, 1, 1, 0, 1, 0), (30, 0.0, 6, 0.0, 26, 0.0, 0, 1, 0, 0, 0),
    (10, 0.0, 30, 0.0, 12, 0.0, 0, 1, 0, 0, 0), (65, 0.0, 3, 1.0, 8, 0.0, 0, 1, 0, 0, 0), (2, 1.0, 5, 0.0, 3, 1.0, 0, 1, 0, 0, 0),
    (1, 1.0, 2, 1.0, 3, 1.0, 0, 1, 0, 0, 0), (6, 0.0, 40, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (2, 0.0, 80, 0.0, 35, 0.0, 0, 1, 1, 0, 0),
    # text of an article element, links in it, and its title as a link
    (9, 0.0, 14, 0.0, 40, 0.0, 1, 0, 1, 1, 1), (40, 0.0, 9, 0.0, 62, 0.0, 1, 0, 0, 1, 1), (62, 0.1, 40, 0.0, 8, 0.0, 1, 0, 0, 1, 1),
    (8, 0.0, 62, 0.1, 12, 0.2, 1, 0, 0, 1, 1), (2, 0.0, 3, 1.0, 1, 0.0, 1, 0, 1, 1, 1), (1, 0.0, 2, 0.0, 4, 0.5, 1, 0, 0, 1, 1),
    (3, 0.0, 1, 0.0, 5, 0.0, 1, 0, 0, 1, 1), (120, 0.02, 2, 0.0, 3, 1.0, 1, 0, 0, 1, 1), (9, 0.0, 30, 0.0, 4, 1.0, 1, 0, 0, 1, 1),
    (1, 0.0, 5, 0.0, 1, 1.0, 1, 0, 0, 1, 1), (17, 0.0, 22, 0.0, 2, 1.0, 1, 0, 0, 1, 1), (1, 0.0, 9, 0.0, 12, 0.0, 1, 0, 0, 1, 1),
    (2, 0.0, 7, 1.0, 12, 0.0, 1, 0, 0, 1, 1), (6, 0.4, 30, 0.0, 25, 0.0, 1, 0, 0, 1, 1), (22, 0.4, 30, 0.0, 3, 1.0, 1, 0, 0, 1, 1),
    (5, 1.0, 30, 0.0, 33, 0.0, 1, 0, 0, 1, 1), (4, 1.0, 12, 0.0, 41, 0.0, 1, 0, 0, 1, 1), (8, 0.9, 55, 0.0, 20, 0.1, 1, 0, 0, 1, 1),
    (11, 0.7, 18, 0.2, 9, 0.0, 1, 0, 0, 1, 1), (6, 1.0, 8, 0.0, 60, 0.0, 1, 0, 1, 1, 1), (4, 1.0, 2, 0.1, 35, 0.0, 1, 0, 1, 1, 1),
    (7, 1.0, 2, 1.0, 44, 0.0, 1, 0, 1, 1, 1), (5, 1.0, 3, 1.0, 70, 0.0, 1, 0, 1, 1, 1),
    (3, 0.0, 40, 0.0, 5, 1.0, 1, 0, 0, 1, 1), (5, 0.0, 18, 0.0, 2, 1.0, 1, 0, 0, 1, 1), (7, 0.1, 25, 0.0, 4, 1.0, 1, 0, 0, 1, 1),
    (8, 0.0, 3, 1.0, 6, 1.0, 1, 0, 0, 1, 1), (2, 0.0, 60, 0.0, 3, 1.0, 1, 0, 0, 1, 1), (6, 0.3, 12, 0.0, 7, 0.9, 1, 0, 0, 1, 1),
    (5, 1.0, 30, 0.0, 20, 0.0, 1, 0, 0, 1, 1), (6, 1.0, 12, 0.0, 10, 0.0, 1, 0, 0, 1, 1), (9, 1.0, 15, 0.1, 22, 0.0, 1, 0, 0, 1, 1),
    (4, 1.0, 7, 0.0, 9, 0.2, 1, 0, 0, 1, 1), (7, 1.0, 48, 0.0, 90, 0.0, 1, 0, 0, 1, 1), (10, 0.9, 80, 0.0, 14, 0.0, 1, 0, 0, 1, 1),
    (5, 1.0, 4, 1.0, 16, 0.0, 1, 0, 1, 1, 1), (8, 1.0, 2, 1.0, 9, 0.0, 1, 0, 1, 1, 1),
    (30, 0.0, 4, 1.0, 0, 0.0, 1, 0, 0, 1, 1), (12, 0.0, 5, 1.0, 2, 0.0, 1, 0, 0, 1, 1), (6, 0.0, 3, 1.0, 3, 0.0, 1, 0, 0, 1, 1),
    (3, 0.2, 6, 1.0, 0, 0.0, 1, 0, 0, 1, 1), (15, 0.1, 8, 0.9, 4, 1.0, 1, 0, 0, 1, 1),
    # lists of links and buttons inside an article element, and the headings over such lists
    (2, 1.0, 44, 0.0, 0, 0.0, 1, 0, 0, 1, 0), (2, 1.0, 38, 0.0, 12, 0.0, 1, 0, 0, 1, 0), (3, 1.0, 52, 0.0, 2, 1.0, 1, 0, 0, 1, 0),
    (2, 1.0, 3, 1.0, 26, 0.0, 1, 0, 0, 1, 0), (6, 1.0, 5, 1.0, 7, 1.0, 1, 0, 0, 1, 0), (4, 1.0, 9, 0.0, 6, 1.0, 1, 0, 0, 1, 0),
    (5, 1.0, 6, 1.0, 14, 0.0, 1, 0, 0, 1, 0), (9, 1.0, 8, 0.9, 10, 1.0, 1, 0, 0, 1, 0), (7, 0.8, 4, 1.0, 22, 0.0, 1, 0, 0, 1, 0),
    (1, 1.0, 20, 0.0, 25, 0.0, 1, 0, 0, 1, 0), (5, 1.0, 3, 0.0, 6, 1.0, 1, 0, 0, 1, 0), (8, 1.0, 6, 1.0, 0, 0.0, 1, 0, 0, 1, 0),
    (2, 0.0, 48, 0.0, 6, 1.0, 1, 0, 1, 1, 0), (3, 0.0, 30, 0.0, 5, 1.0, 1, 0, 1, 1, 0), (2, 0.0, 61, 0.0, 8, 0.9, 1, 0, 1, 1, 0),
    (2, 1.0, 80, 0.0, 60, 0.0, 1, 0, 0, 1, 0), (3, 1.0, 14, 0.0, 40, 0.0, 1, 0, 0, 1, 0), (1, 1.0, 33, 0.0, 70, 0.0, 1, 0, 0, 1, 0),
    (2, 1.0, 9, 0.0, 100, 0.0, 1, 0, 0, 1, 0), (3, 1.0, 25, 0.1, 18, 0.0, 1, 0, 0, 1, 0), (4, 1.0, 7, 1.0, 30, 0.0, 1, 0, 0, 1, 0),
    (6, 1.0, 5, 1.0, 44, 0.0, 1, 0, 0, 1, 0), (7, 1.0, 60, 0.0, 5, 1.0, 1, 0, 0, 1, 0), (9, 1.0, 41, 0.0, 8, 1.0, 1, 0, 0, 1, 0),
    (12, 0.9, 6, 1.0, 9, 1.0, 1, 0, 0, 1, 0), (5, 1.0, 8, 1.0, 0, 0.0, 1, 0, 0, 1, 0), (10, 0.8, 7, 0.9, 35, 0.0, 1, 0, 0, 1, 0),
    (4, 0.0, 22, 0.0, 7, 1.0, 1, 0, 1, 1, 0), (1, 0.0, 75, 0.0, 4, 1.0, 1, 0, 1, 1, 0),
    # beside an article element, without a mark
    (7, 0.0, 33, 0.0, 41, 0.0, 0, 0, 0, 1, 0), (45, 0.0, 7, 0.0, 3, 0.0, 0, 0, 0, 1, 0), (3, 0.0, 45, 0.0, 2, 1.0, 0, 0, 1, 1, 0),
    (6, 0.9, 2, 1.0, 5, 1.0, 0, 0, 0, 1, 0), (28, 0.0, 3, 0.0, 30, 0.0, 0, 0, 0, 1, 0), (11, 0.0, 0, 0.0, 25, 0.0, 0, 0, 1, 1, 0),
    # pages without article or main element
    (1, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 1, 1.0, 7, 0.0, 0, 0, 0, 0, 0), (7, 0.0, 2, 1.0, 38, 0.0, 0, 0, 1, 0, 1),
    (38, 0.0, 7, 0.0, 51, 0.0, 0, 0, 0, 0, 1), (51, 0.05, 38, 0.0, 9, 0.0, 0, 0, 0, 0, 1), (9, 0.0, 51, 0.05, 22, 0.0, 0, 0, 0, 0, 1),
    (22, 0.1, 9, 0.0, 4, 0.6, 0, 0, 0, 0, 1), (4, 0.6, 22, 0.1, 3, 1.0, 0, 0, 0, 0, 0), (3, 1.0, 4, 0.6, 0, 0.0, 0, 0, 0, 0, 0),
    (3, 0.0, 38, 0.0, 47, 0.0, 0, 0, 0, 0, 1), (4, 0.0, 29, 0.0, 60, 0.0, 0, 0, 1, 0, 1), (6, 0.0, 44, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (5, 0.0, 0, 0.0, 33, 0.0, 0, 0, 1, 0, 1), (80, 0.0, 5, 0.0, 77, 0.0, 0, 0, 0, 0, 1), (16, 0.8, 21, 0.0, 8, 0.9, 0, 0, 0, 0, 0),
    (24, 0.7, 8, 0.9, 12, 1.0, 0, 0, 0, 0, 0), (2, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 2, 0.9, 1, 1.0, 0, 0, 0, 0, 0),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (9, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (41, 0.0, 30, 0.0, 3, 1.0, 0, 0, 0, 0, 1),
    (19, 0.0, 34, 0.0, 2, 1.0, 0, 0, 0, 0, 1), (12, 0.0, 19, 0.0, 5, 1.0, 0, 0, 0, 0, 1), (48, 0.3, 20, 0.0, 31, 0.0, 0, 0, 0, 0, 1),
    (13, 0.0, 11, 0.2, 19, 0.1, 0, 0, 0, 0, 1), (35, 0.2, 2, 1.0, 40, 0.0, 0, 0, 0, 0, 1), (1, 0.0, 40, 0.0, 15, 0.0, 0, 0, 0, 0, 1),
    (2, 0.0, 31, 0.0, 4, 1.0, 0, 0, 1, 0, 0), (4, 1.0, 26, 0.0, 30, 0.0, 0, 0, 0, 0, 1), (5, 1.0, 40, 0.0, 18, 0.0, 0, 0, 0, 0, 1),
    (6, 0.0, 44, 0.0, 4, 1.0, 0, 0, 0, 0, 1), (4, 0.0, 27, 0.0, 2, 1.0, 0, 0, 0, 0, 1), (8, 0.1, 60, 0.0, 5, 1.0, 0, 0, 0, 0, 1),
    (3, 0.0, 55, 0.0, 3, 1.0, 0, 0, 1, 0, 0), (2, 1.0, 50, 0.0, 45, 0.0, 0, 0, 0, 0, 0), (3, 1.0, 20, 0.0, 3, 0.0, 0, 0, 0, 0, 0),
    (25, 0.0, 4, 1.0, 0, 0.0, 0, 0, 0, 0, 1), (40, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 1), (2, 1.0, 0, 0.0, 3, 1.0, 0, 0, 1, 0, 0),
    (5, 1.0, 7, 1.0, 6, 1.0, 0, 0, 0, 0, 0), (8, 1.0, 33, 0.0, 7, 1.0, 0, 0, 0, 0, 0), (6, 1.0, 2, 1.0, 50, 0.0, 0, 0, 1, 0, 1),
)


@dataclass(frozen=True)
class Tree:
    """A node of a decision tree: rows with x[column] <= cut go left."""

    share: float
    column: int = -1
    cut: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None or self.right is None:
            return np.full(len(x), self.share)
        out, low = np.empty(len(x)), x[:, self.column] <= self.cut
        out[low], out[~low] = self.left.predict(x[low]), self.right.predict(x[~low])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """The tree that splits by the least Gini impurity until leaves are pure; ties go to the first column and lowest cut."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return Tree(share)
    best = None
    for column in range(x.shape[1]):
        values = np.unique(x[:, column])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, column] <= cut
            impure = sum(part.sum() * y[part].mean() * (1 - y[part].mean()) for part in (low, ~low))
            if best is None or impure < best[0] - 1e-12:
                best = (impure, column, float(cut), low)
    if best is None:
        return Tree(share)
    _, column, cut, low = best
    return Tree(share, column, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def features(rows: np.ndarray) -> np.ndarray:
    """Rows of TABLE as the tree's COLUMNS."""
    x = np.delete(rows, TABLE.index("has_main"), axis=1)
    x[:, 0:6:2] = np.minimum(x[:, 0:6:2], ENOUGH)
    x[:, COLUMNS.index("place")] = np.where(rows[:, TABLE.index("in_main")] > 0, 1.0, np.where(rows[:, TABLE.index("has_main")] > 0, 0.0, 0.5))
    return x


@lru_cache(1)
def trained() -> Tree:
    table = np.array(BLOCKS, float)
    return grow(features(table[:, :-1]), table[:, -1])


def _marks(name: str, attrs: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element marks the article, or what is beside it, by tag or role, or by a class or id value; and whether that says OTHERS."""
    main, aside, named, others = name in MAIN_TAGS, name in ASIDE_TAGS, False, False
    if attrs:
        for kind, *value in ATTRIBUTE.findall(attrs):
            text = "".join(value)
            if kind.lower() == "role":
                main, aside = main or text.lower() == "main", aside or text.lower() in ASIDE_ROLES
            elif not main and name not in ("body", "html"):
                found = [w for w in text.split() if len(w) <= LONGEST_VALUE and ASIDE_VALUE.fullmatch(w)]
                named = named or bool(found)
                others = others or any(not OTHERS.isdisjoint(re.split("[-_]", w.lower())) for w in found)
    return main, aside, named, others


@dataclass
class Element:
    """An element of a page: what it marks, whether it has an end tag of its own, and whether an article begins inside it."""

    name: str
    main: bool = False
    aside: bool = False
    named: bool = False
    others: bool = False
    closed: bool = False
    holds_main: bool = False
    words: int = 0
    outer: Element | None = None


def _scanned(page: str) -> list[tuple[int, int, str, bool, Element | None]]:
    """(begin, end, name, is end tag, element) of the page's tags; elements are those that enclose something."""
    out, stack, open_, mains = [], [], Counter(), 0
    for token in TOKEN.finditer(page):
        name, element = (token["name"] or "").lower(), None
        if name and token["close"]:
            if open_[name]:
                while True:
                    ended, before = stack.pop()
                    open_[ended.name] -= 1
                    ended.holds_main = mains > before
                    if ended.name == name:
                        ended.closed, element = True, ended
                        break
        elif name and name not in VOID and not token["attrs"].endswith("/"):
            marks = _marks(name, token["attrs"])
            if name not in INLINE or marks[1] or marks[2]:
                if name in ("p", "li") and stack and stack[-1][0].name == name:  # an open one ends here
                    open_[name] -= 1
                    stack.pop()
                mains += marks[0]
                element = Element(name, *marks)
                stack.append((element, mains))
                open_[name] += 1
        out.append((token.start(), token.end(), name, bool(token["close"]), element))
    for element, before in stack:
        element.holds_main = mains > before
    return out


def blocks(page: str) -> list[tuple[str, float, bool, bool, bool]]:
    """(text, link density, in main, in aside, heading) of each non-empty text block, in page order."""
    out: list[tuple[str, float, bool, bool, bool]] = []
    #: The innermost named element around each block, and all such elements in order.
    within: list[Element | None] = []
    seen: list[Element] = []
    stack: list[Element] = []
    mains = asides = others = linked = link = 0
    #: Elements now open that their name or a class or id value alone sets aside.
    named: list[Element] = []
    parts: list[str] = []
    heading = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                words = len(text.split(" "))
                out.append((text, min(1.0, linked / words), mains > 0, asides > 0, heading))
                within.append(named[-1] if named else None)
                if named:
                    named[-1].words += words
            parts.clear()
            linked = 0

    def enter(element: Element) -> None:
        nonlocal mains, asides, others
        if element.others:  # an article in it is one of theirs
            element.aside, element.named = True, False
        elif others:
            element.main = False
        others += element.others
        if element.main:  # what has no end of its own ends where an article begins
            for other in stack if asides or named else ():
                if not other.closed:
                    asides -= other.aside
                    others -= other.others
                    other.others = False
                    if other.named:
                        named.remove(other)
                    other.aside = other.named = False
        elif element.name == "header" and (mains or element.holds_main):
            element.aside = False
        elif element.name in FORMS:  # some wrap the whole page
            element.aside, element.named = False, True
        if element.named and element.holds_main:
            element.named = False
        stack.append(element)
        mains, asides = mains + element.main, asides + element.aside
        if element.named:
            element.outer = named[-1] if named else None
            named.append(element)
            seen.append(element)

    def leave() -> Element:
        nonlocal mains, asides, others
        element = stack.pop()
        mains, asides, others = mains - element.main, asides - element.aside, others - element.others
        if element.named:
            named.pop()
        return element

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if link:
                linked += len(text.split())

    at = 0
    for begin, end, name, closes, element in _scanned(page):
        say(page[at:begin])
        at = end
        if name == "a":
            link = 0 if closes else 1
        elif name == "br":
            parts.append(" ")
        if not name or name in INLINE and element is None:
            continue
        flush()
        heading = name in HEADINGS and not closes
        if element is not None and not closes:
            if name in ("p", "li") and stack and stack[-1].name == name:
                leave()
            enter(element)
        elif element is not None:
            while leave() is not element:
                pass
            link = 0
    say(page[at:])
    flush()
    for element in reversed(seen):
        if element.outer is not None:
            element.outer.words += element.words
    # a wrapper of most of the page's text is not beside the article, whatever its name, unless an article stands elsewhere;
    # of wrappers in one another the innermost has the fewest words
    most = WRAPPER * sum(len(b[0].split(" ")) for b in out)
    beside = [b[3] or own is not None and own.words <= most for b, own in zip(out, within, strict=True)]
    if any(b[2] and not a for b, a in zip(out, beside, strict=True)):
        beside = [b[3] or own is not None for b, own in zip(out, within, strict=True)]
    return [(*b[:3], a, b[4]) for b, a in zip(out, beside, strict=True)]


def main_text(pages: list[str]) -> list[str]:
    """The main text of each page; one call of the tree for all."""
    found = [blocks(p) for p in pages]
    rows = []
    for page in found:
        words = [len(b[0].split(" ")) for b in page]
        any_main = any(b[2] and not b[3] for b in page)
        for i, b in enumerate(page):
            before = (words[i - 1], page[i - 1][1]) if i else (0, 0.0)
            after = (words[i + 1], page[i + 1][1]) if i + 1 < len(page) else (0, 0.0)
            rows.append((words[i], b[1], *before, *after, b[2], b[3], b[4], any_main))
    keep = iter((trained().predict(features(np.array(rows, float))) >= 0.5).tolist() if rows else ())
    out = []
    for page in found:
        kept = [b for b in page if next(keep)]
        if not any(b[2] for b in kept) and any(b[2] and not b[3] for b in page):  # an article of links, as a table of contents
            kept = [b for b in page if b[2] and not b[3]]
        out.append("\n".join(b[0] for b in kept))
    return out


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_text(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
