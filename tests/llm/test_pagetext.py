import math
import re
from html import unescape

import pytest

from cairnspark.llm import pagetext

PAGE = """<!DOCTYPE html><html><head><title>Head</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1><p>Motto of the site</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- a comment --><div class="ad">Buy this thing now, it is cheap and good</div>
<div class="cookie-notice">We use cookies to make this site work for everybody</div>
%s
<aside><p>Most read: a long list of other things to read on this site today</p></aside>
<section id="comments"><p>First! What a nice article, I liked reading it a lot, thanks.</p></section>
<form><label>Mail</label><button>Sign up</button></form><footer>&copy; 2024 &middot; Somebody</footer></body></html>"""
BODY = """<h1>The title</h1><p><b>First paragraph, long enough &amp; with a<br>break   and&nbsp;blank.<p>Short.
<div class="ads">Ad inside</div><p>Last paragraph with <a href="x">a link</a> and <i>more</i> words than the others have.</p>"""
TEXT = "The title\n\nFirst paragraph, long enough & with a break and blank.\n\nShort.\n\nLast paragraph with a link and more words than the others have."


@pytest.mark.parametrize("frame", ["<article>%s</article>", "<main>%s</main>", '<div id="content">%s</div>', "<main><article>%s</article></main>"])
def test_article_in_several_frames(frame):
    assert pagetext.main_text(PAGE % (frame % BODY)) == TEXT


def test_end_tags_missing():
    page = (PAGE % ("<article>" + BODY + "</article>")).replace("</body></html>", "")
    assert pagetext.main_text(page) == TEXT


@pytest.mark.parametrize(
    "html,text",
    [(None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b<script>x", "a\n\nb"), ("<nav>x</nav>", ""), ("<p></p>", ""), ("</div></p>y", "y"), ("<p>&eacute;&#x41;&lt;", "éA<")],
)
def test_odd_pages(html, text):
    assert pagetext.main_text(html) == text


LONG = "A paragraph of an ordinary length, as most of them are, with a few more words behind it."


def joined(*parts):
    return "\n\n".join(parts)


def test_page_wide_form():
    page = f"<body><form action=/x><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></article></form></body>"
    assert pagetext.main_text(page) == joined("Title", LONG, LONG)
    small = f"<body><article><h1>Title</h1><p>{LONG}</p><form><label>Your mail</label><input></form><p>{LONG}</p></article></body>"
    assert pagetext.main_text(small) == joined("Title", LONG, LONG)


def test_names_inside_an_article():
    page = f'<article><h1>Title</h1><p>{LONG}</p><div class="share-prices"><p>Prices: {LONG}</p></div><div class="share-buttons">Share this</div><div class="share-this-page-now">Share</div><p>{LONG}</p></article>'
    assert pagetext.main_text(page) == joined("Title", LONG, "Prices: " + LONG, LONG)
    whole = f'<body><div class="comment-free-layout"><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div id="comments"><p>{LONG}</p></div></body>'
    assert pagetext.main_text(whole) == joined(LONG, "Short.", LONG)


@pytest.mark.parametrize("n", [1, 5, 400])
def test_linked_and_very_long_paragraphs(n):
    linked = 'See <a href="/a">this page</a> and <a href="/b">that one</a>.'
    blocks = [LONG, LONG, (LONG + " ") * n, linked, "Short.", LONG, linked]
    menu = '<div><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></div>'
    page = f"<body>{menu}<div><h2>Title</h2>" + "".join(f"<p>{b}</p>" for b in blocks) + f"</div><div><a href=/>All news of this day</a></div>{menu}</body>"
    plain = [b.strip() if b != linked else "See this page and that one." for b in blocks]
    assert pagetext.main_text(page) == joined("Title", *plain)


def test_comments_longer_than_the_article():
    page = f'<main><p>{LONG}</p><section class="comments-list">' + f"<article><p>{LONG}</p></article>" * 9 + "</section></main>"
    assert pagetext.main_text(page) == LONG


def plain_threshold(values):
    mean = sum(values) / len(values)
    at = min((sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5, max(values))
    while True:
        low, high = [v for v in values if v < at], [v for v in values if v >= at]
        if not low or not high:
            return at
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - at) < 1e-12:
            return at
        at = new


def test_ratios_and_threshold():
    assert pagetext.smoothed([]) == [] and pagetext.smoothed([3.0, 3.0, 3.0]) == pytest.approx([3, 3, 3])
    sizes = (4, 4, 400, 500, 450, 4, 4)
    lines = [pagetext.Line("x" * n, 2, 0, 0) for n in sizes]
    seeds = pagetext.content_seeds(lines, [pagetext.PLAIN] * 7)
    weights = [math.exp(-d * d / 2) for d in (-2, -1, 0, 1, 2)]
    ratios = [math.log1p(n / 2) for n in sizes]
    smooth = [sum(w * ratios[min(6, max(0, i + d))] for w, d in zip(weights, (-2, -1, 0, 1, 2))) / sum(weights) for i in range(7)]
    assert seeds == [v >= plain_threshold(smooth) for v in smooth] == [False, False, True, True, True, False, False]
    around = pagetext.content_seeds(lines, [pagetext.AROUND] * 4 + [pagetext.PLAIN] * 3)
    assert not any(around[:4]) and around[4]


def articles(html):
    """The blocks of a page that has one article, by cutting its source at block tags."""
    body = re.search("<article>(.*)</article>", html, re.S)[1]
    blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:h1|p|br)>", body)]
    return [b for b in blocks if b]


def test_given_pages_against_plain_cutting(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pagetext.extract(pages).collect()
    for r in rows:
        # A <br> inside a paragraph is a blank, but all of these stand before the end of one.
        assert r.main.text == joined(*articles(r.html)) and r.main.n_chars == len(r.main.text)
    monkeypatch.setattr(pagetext, "content_seeds", lambda lines, standing: [True] * len(lines))
    assert any(pagetext.main_text(r.html) != r.main.text for r in rows)  # the ratios decide


def test_deep_and_long_pages_take_linear_time():
    assert pagetext.main_text("<div>" * 50000 + "deep") == "deep"
    long = "<article>" + "<p>word <b>and</b> more</p>" * 50000 + "</article>"
    assert pagetext.main_text(long).count("\n\n") == 49999


def test_operator(spark):
    rows = [(1, PAGE % ("<article>" + BODY + "</article>")), (1, None), (None, "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'u' as main", "0 as n_chars")
    got = sorted((r.page_id or 0, r.main.text, r.main.n_chars) for r in pagetext.extract(pages).collect())
    assert got == [(0, "é", 1), (1, "", 0), (1, TEXT, len(TEXT))]
    assert pagetext.extract(pages.where("false")).collect() == []
