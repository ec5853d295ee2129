import html
import re

from tests.conftest import SF_SMALL
from tests.llm.cases import as_set, with_clashes
from turnforge.llm.common import read
from turnforge.llm.html_text import extract, main_text

LONG = "A sentence of the article that says something at some length, so that it counts. " * 3


def by_hand(page):
    """The article's text by patterns, for pages that have one article element without nested boilerplate."""
    body = re.search(r"<article[^>]*>(.*?)(?:</article>|$)", page, re.S)[1]
    body = re.sub(r"</?(?:b|i|a|em|strong|span)(?:\s[^>]*)?>", "", body)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", body)).split())


def test_pages_equal_the_article_by_hand(spark):
    pages = read(spark, SF_SMALL, "pages")
    want = sorted((r.page_id, r.url, by_hand(r.html), len(by_hand(r.html))) for r in pages.collect())
    assert as_set(main_text(with_clashes(pages)), "page_id", "url", "text", "n_chars") == sorted(want, key=repr)


def test_boilerplate_around_and_inside():
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body class="has-sidebar">
    <div id="header">Site name</div><div role="navigation"><a href=x>Menu</a></div><div class="cookie-notice">We use cookies</div>
    <div class="layout with-sidebar"><div class="post"><h1>T&amp;t &copy; 1</h1><p>{LONG}<p>Short.<ul><li>one<li>two</ul>
    <div class="ad">Buy!</div><script>if (a < b) document.write("<p>x</p>")</script><p>{LONG}</div>
    <aside>Related</aside><section id="comments"><p>{LONG}{LONG}</section></div><form><label>Mail</label></form><footer>c</footer>"""
    once = " ".join(LONG.split())
    assert extract(page) == f"T&t © 1 {once} Short. one two {once}"


def test_header_inside_an_article_stays():
    assert extract(f"<header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>{LONG}</p><footer>by me</footer></main>") == "Title " + " ".join(LONG.split())


ONCE = " ".join(LONG.split())
BODY = f"<p>{LONG}</p>" * 9
NINE = " ".join([ONCE] * 9)


def test_what_stands_beside_the_main_block_stays():
    assert extract(f"<body><div class=wrap><h1>T</h1><div class=lead>{LONG}</div><div class=body>{BODY}</div></div><footer>f</footer>") == f"T {ONCE} {NINE}"
    assert extract(f"<body><h1>T</h1><div class=body>{BODY}</div>") == f"T {NINE}"
    assert extract(f"<main><h1>T</h1><p>intro</p><article>{BODY}</article></main>") == f"T intro {NINE}"


def test_head_without_its_end_tag():
    for start in ("<body>", "", "<div>", "<p>", "<b>x</b>", "plain "):
        text = {"<b>x</b>": "x ", "plain ": "plain "}.get(start, "") + ONCE
        assert extract(f"<html><head><meta charset=utf-8><title>t</title><style>p{{}}</style>\n{start}<p>{LONG}</p></html>") == text, start
    assert extract(f"<html><head><title>t</title></head><body><article><p>{LONG}</p></article></body></html>") == ONCE


def test_boilerplate_paragraphs_and_inline_elements():
    page = f"<div><p class=cookie-notice>We use cookies<p>{LONG}</p><p hidden>gone</p><p>a<span hidden>x<span>y</span>z</span>b <a class='share'>Share</a><p>{LONG}</div>"
    assert extract(page) == f"{ONCE} ab {ONCE}"
    assert extract(f"<div><p><span hidden>never closed<p>{LONG}</div>") == ONCE


def test_page_shapes():
    p, links = f"<p>{LONG}</p>", "<a href=1>Home</a> <a href=2>About us</a> <a href=3>Contact</a>"
    shapes = [
        (f'<div class="post social">{p}{p}</div><footer>f</footer>', f"{ONCE} {ONCE}"),
        (f'<nav>{links}</nav><div class="widget-area main-content">{p}{p}</div>', f"{ONCE} {ONCE}"),
        (f'<main><div class="alert">{p}</div></main>', ONCE),
        (f'<article><h1>T</h1>{p}<section id="related-work"><h2>Related work</h2>{p}</section></article>', f"T {ONCE} Related work {ONCE}"),
        (f'<article>{p}</article><article class="comment">{p}{p}</article><article class="comment">{p}</article>', ONCE),
        (f'<main><h1>T</h1>{p}</main><section id=comments><article id="comment-7">{p}</article></section>', f"T {ONCE}"),
        (f'<article>{p}<div class="discussion">{p}{p}{p}{p}{p}</div></article>', ONCE),
        (f'<div class="cookieconsent">{p}</div><article>{p}</article>', ONCE),
        (f'<div id="cookiebanner">{p}{p}{p}{p}{p}</div><article>{p}</article>', ONCE),
        (f"<body><h1>T</h1><div class=t>{links}</div><div class=b>{p}</div>", f"T {ONCE}"),
        (f"<body><h1>T</h1><ul><li><a href=1>Home</a><li><a href=2>About</a></ul><div class=b>{p}</div>", f"T {ONCE}"),
        (f"<article>{p}<ul><li><a href=1>One source</a><li><a href=2>Two sources</a></ul></article>", f"{ONCE} One source Two sources"),
        (f"<body><div class=b>{p}<p>See <a href=1>this</a> and <a href=2>that</a> page.</p></div>", f"{ONCE} See this and that page."),
        (f'<article>{p}<div class="ad">Buy now</div><div class="newsletter-signup">Join the list</div>{p}</article>', f"{ONCE} {ONCE}"),
        (f'<article>{p}<div class="related-posts"><a href=1>One</a><p>More to read</p></div></article>', ONCE),
        (f'<div class="sidebar">{p}</div><article><p>A short article.</p></article>', "A short article."),
        (f'<div class="content"><h1>T</h1>{p}<div class="share">Share this</div></div><div class="comments">{p}{p}{p}{p}{p}</div>', f"T {ONCE}"),
        (f'<div class="page-header">Site</div><div id="main"><div class="entry">{p}</div></div><div class="pagination">{links}</div>', ONCE),
        (f"<table><tr><td>{links}</td><td>{p}</td></tr></table>", ONCE),
        (f'<body><a href=0>Skip<div class=b>{p}</div>', ONCE),
        (f'<article>{p}<figure><img src=x><figcaption>A caption</figcaption></figure><blockquote>{p}</blockquote></article>', f"{ONCE} A caption {ONCE}"),
        ('<div class="alert">Only this</div>', "Only this"),
    ]
    for page, want in shapes:
        assert extract(page) == want, page


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep " + LONG
    odd = ["", None, "   ", "plain text &lt;b&gt; &#x41;&nbsp;x", "<p>a<p>b<br>c", "<p>un<b>closed", "<!-- only --><script>x", "<", "<article></article>", "<div hidden>x</div><p>y", "<td>1</td><td>2</td>", "x" * 300_000, deep]
    want = ["", "", "", "plain text <b> A x", "a b c", "unclosed", "", "<", "", "y", "1 2", "x" * 300_000, "deep " + " ".join(LONG.split())]
    assert [extract(p or "") for p in odd] == want
    rows = [(k, None, p) for k, p in enumerate(odd)] + [(None, "u", "<p>z"), (0, None, ""), (0, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert main_text(df.limit(0)).count() == 0
