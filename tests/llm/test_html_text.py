"""Operator 6 on small pages whose article is known, and on odd rows."""

from __future__ import annotations

import pytest

from quernlake.llm import html_text

FRAME = """<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t = "</p><p>no</p>";</script></head><body class="has-sidebar">
<header><a href="/">Home</a> Daily news of the town for everyone who lives here</header>
<nav><ul><li><a href="/a">First</a></li><li><a href="/b">Second</a></li></ul></nav>
<div class="cookie-banner">We use cookies to make this site work better for all of its readers.</div>
{body}
<aside><h3>Related</h3><p>Another article that is not this one but has quite some words in it.</p></aside>
<div id="comments"><h2>Comments</h2><p>Reader one: what a fine article this is, I have read it twice already.</p></div>
<form><label>Your mail</label><input name="m"><button>Subscribe</button></form>
<footer>&copy; 2024 Example &middot; All rights reserved by the publisher of this page.</footer></body></html>"""
PARAGRAPHS = [
    "A title of the article", "The first paragraph tells what happened & why, in a sentence of some length that goes on for a while.",
    "A second one has a link inside, and then it ends.", "Short.", "The last paragraph of the article closes it with a few more words for the tree to count.",
]
ARTICLE = """<h1>A title of the   article</h1><p>The first paragraph tells what happened &amp; why, in a <b>sentence</b> of some length
that goes on for a while.<div class="ad">Buy now, this is an advert with plenty of words to look like prose.</div><p>A second one has
<a href="/x">a link</a>&#32;inside, and then it ends.</p><!-- <p>hidden</p> --><p>Short.</p><p>The last paragraph of the article closes it with a few more words for the tree to count.</p>"""


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_article(tag):
    page = FRAME.format(body=f"<{tag}>{ARTICLE}</{tag}>")
    assert html_text.main_text([page]) == ["\n".join(PARAGRAPHS)]


def test_blocks_have_density():
    found = html_text.blocks('<p>one two <a href="/">three four</a></p><h2>five</h2>')
    assert found == [("one two three four", 0.5, False, False, False), ("five", 0.0, False, False, True)]


def test_tree_fits_its_table():
    import numpy as np

    rows = np.array(html_text.BLOCKS, float)
    assert ((html_text.trained().predict(html_text.features(rows[:, :-1])) >= 0.5) == rows[:, -1]).all()


def test_odd_rows(spark):
    long = "<article>" + "<p>many words in a row, again and again until the end of it</p>" * 20_000 + "</article>"
    pages = [
        (1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "just text without any tag at all, of a few words"), (4, "u", "just text without any tag at all, of a few words"), (None, "u", "<article><p>no id here, but some words</p>"),
        (5, "u", long), (6, "u", "<div><script>never closed"), (7, "u", "< > & <3 and a <b unclosed"),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars").repartition(3)
    got = html_text.extract(table).collect()
    assert got and sorted(map(str, (r.page_id for r in got))) == sorted(map(str, (p[0] for p in pages)))
    of = {r.page_id: r for r in got}
    assert of[1].text == of[2].text == of[3].text == of[6].text == ""
    assert of[4].text.startswith("just text")
    assert of[None].text == "no id here, but some words"
    assert of[5].text.count("\n") == 19_999
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(table.limit(0)).collect() == []


def test_pages(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    got = html_text.extract(pages).collect()
    assert len(got) == pages.count()
    assert all(r.text and "<p>" not in r.text and "track(" not in r.text for r in got)


@pytest.mark.parametrize("mark", ["has-sidebar", "layout no-comments", "header-fixed", "with_login", "page has-sidebar", "layout-with-sidebar", "post comments-open"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_wrapper_class_is_not_an_aside(mark, tag):
    page = f'<div class="{mark}"><{tag}>{ARTICLE}</{tag}></div><div class="sidebar"><p>Some words beside the article that are not part of it.</p></div>'
    assert html_text.main_text([page]) == ["\n".join(PARAGRAPHS)]


def test_article_inside_an_aside_marks_no_page():
    page = f'<div>{ARTICLE}</div><aside><article><p>Another article that is not this one but has quite some words in it.</p></article></aside>'
    assert html_text.main_text([page]) == ["\n".join(PARAGRAPHS)]


BESIDE = '<div class="sidebar"><p>Some words beside the article that are not part of it.</p></div>'


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="page has-sidebar"><article>{ARTICLE}</article></div>{BESIDE}',
        f'<main class="layout-with-sidebar">{ARTICLE}</main>{BESIDE}',
        f'<article class="post comments-open">{ARTICLE}</article>{BESIDE}',
        f'<nav><a href="/a">First</a> <a href="/b">Second</a><article>{ARTICLE}</article>{BESIDE}',
        f'<div class="menu"><a href="/a">First</a><main>{ARTICLE}</main>{BESIDE}',
        f'<article><header>{ARTICLE.split("</h1>")[0]}</h1></header>{ARTICLE.split("</h1>")[1]}</article>{BESIDE}',
        f'<article><div class="entry-header">{ARTICLE.split("</h1>")[0]}</h1></div>{ARTICLE.split("</h1>")[1]}</article>{BESIDE}',
        f'<div>{ARTICLE}</div><ol class="commentlist"><li><p>Reader one: what a fine article this is, I have read it twice.</p></li></ol>{BESIDE}',
        f'<article>{ARTICLE}<p><a href="/m">Read more</a></p><div><a href="/b">Buy now</a></div></article>{BESIDE}',
        f'<article>{ARTICLE}<h3>Further reading</h3><ul><li><a href="/1">Another story of the day</a></li><li><a href="/2">And one more of last week</a></li></ul></article>{BESIDE}',
        f'<form id="whole"><div class="site-header">The name of a site</div><div>{ARTICLE}</div></form>{BESIDE}',
        f'<div class="widget-area">Weather today</div><article>{ARTICLE}</article><section id="comments"><p>{"A comment longer than the article itself. " * 40}</p></section>',
    ],
)
def test_layouts(page):
    assert html_text.main_text([page]) == ["\n".join(PARAGRAPHS)]


def test_neighbours_decide():
    """The tree asks for words and links of neighbours, also on pages with an article element."""
    used = set()

    def walk(node, has_main):
        if node.left is None:
            return
        used.add((html_text.COLUMNS[node.column], has_main))
        walk(node.left, has_main)
        walk(node.right, has_main or html_text.COLUMNS[node.column] == "place")

    walk(html_text.trained(), False)
    assert {name for name, _ in used} >= {"density_before", "density_after", "words"}
    assert any(name in ("density_before", "density_after") and main for name, main in used)


def test_features_equal_brute_force():
    """Words and link density of each block, counted anew on paragraphs of words with links."""
    import random

    rng = random.Random(3)
    for _ in range(50):
        want, page = [], ""
        for _ in range(rng.randrange(1, 8)):
            words = [(f"w{rng.randrange(99)}", rng.random() < 0.4) for _ in range(rng.randrange(1, 12))]
            page += "<p>" + " ".join(f'<a href="/{w}">{w}</a>' if linked else w for w, linked in words) + "</p>"
            want.append((" ".join(w for w, _ in words), sum(linked for _, linked in words) / len(words)))
        assert [(b[0], b[1]) for b in html_text.blocks(page)] == want


def test_stray_end_tags_take_linear_time():
    import time

    began = time.process_time()
    html_text.blocks("<div>" * 50_000 + "<p>text</p>" + "</x>" * 100_000 + "</section>" * 50_000)
    assert time.process_time() - began < 4


LONG = "A sentence of the article that has a good number of words in it, and no link at all."
SAID = "What a reader wrote below the article, in a sentence of some length, without any link."


@pytest.mark.parametrize(
    "page",
    [
        f'<article><p>{LONG}</p></article><div id="comments" class="comments-area"><ol class="comment-list"><li class="comment"><article class="comment-body"><p>{SAID}</p></article></li></ol></div>',
        f'<div class="post"><p>{LONG}</p><p>{LONG}</p></div><div id="comments"><article class="comment"><p>{SAID}</p></article></div>',
        f'<article><p>{LONG}</p></article><section class="related"><article><p>{SAID}</p></article></section>',
        f'<article><p>{LONG}</p></article><div class="reader-comments">{"".join(f"<p>{SAID}</p>" for _ in range(9))}</div>',
        f'<div><p>{LONG}</p></div><div class="user-comments">{"".join(f"<p>{SAID}</p>" for _ in range(9))}</div>',
        *[f'<div><p>{LONG}</p><p>{LONG}</p></div><div class="{c}"><p>{SAID}</p></div>' for c in ("share-buttons", "promo-card", "cc-window", "gdpr-accept", "cookie-law-info-bar", "commentlist")],
    ],
)
def test_what_others_say_goes(page):
    text = html_text.main_text([f"<html><body>{page}</body></html>"])[0]
    assert LONG in text and SAID not in text


@pytest.mark.parametrize("wrapper", ["has-sidebar", "no-comments", "header-fixed", "comments-open", "entry-header"])
def test_values_that_say_nothing_keep_the_article(wrapper):
    assert html_text.main_text([f'<div class="{wrapper}"><p>{LONG}</p><p>{LONG}</p></div>'])[0] == f"{LONG}\n{LONG}"


def test_an_article_of_links_stays():
    page = "<nav><a>Home</a></nav><main><h1>Chapters</h1><ul><li><a>The first chapter of it</a></li><li><a>The second chapter of it</a></li></ul></main>"
    assert html_text.main_text([page])[0] == "Chapters\nThe first chapter of it\nThe second chapter of it"


def test_many_open_marked_elements_take_linear_time():
    import time

    took = []
    for n in (2000, 8000):
        page = f'<div class="widget"><p>{LONG}</p>' * n
        start = time.perf_counter()
        html_text.blocks(page)
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * max(took[0], 0.05)
