"""Main text of whole pages."""

import html
import re

import pytest

from whence.llm.html_text import extracted, main_text
from whence.llm.queries import op7_html_text

LONG = "Words about one thing, and another, follow each other here for a while so that this reads like prose."
MORE = "A second paragraph, with commas, and enough length to count as text that belongs to the article."
AROUND = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x = "<p>no, no, no</p>";</script></head><body>
<header><p>Site header, with commas, and quite some words in it to look like text.</p></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, and so on, and so forth, so please agree to all of them now.</p></div>
{0}
<aside><p>Sidebar, with commas, and quite some words in it to look like text for readers.</p></aside>
<div id="comments"><p>Great article, thanks, really, I liked every single word of what you have written!</p></div>
<form><p>Subscribe, please, to our newsletter and never miss a single thing again.</p><input name="q"></form>
<footer>&copy; Somebody</footer></body></html>"""


@pytest.mark.parametrize(
    "body",
    [
        f"<article><h1>Title</h1><p>{LONG}</p><p>{MORE}</p></article>",
        f"<main><h1>Title</h1><div><p>{LONG}<p>{MORE}</div></main>",
        f'<div class="content"><h1>Title</h1><p>{LONG}</p><div class="ad">Buy, buy, buy now</div><p>{MORE}</p></div>',
        f"<ARTICLE><H1>Title</H1><P>{LONG.replace('thing', '<b>thing</b>')}</P><p>{MORE}<br></ARTICLE>",
    ],
)
def test_the_article_stays_and_the_rest_goes(body):
    assert main_text(AROUND.format(body)) == f"Title {LONG} {MORE}"


def test_references_and_white_space():
    page = f"<article><p>a &amp; b &lt;c&gt; &eacute;&#233;&#x1F600;\n\t d</p><p>{LONG}</p><p>x<br>y</p></article>"
    assert main_text(page) == f"a & b <c> éé\U0001f600 d {LONG} x y"


@pytest.mark.parametrize("page", ["", "<", "<p", "<html></html>", "<!-- never closed <p>x</p>", "<script>never closed", "</p></div>", "<nav><p>x</p></nav>"])
def test_broken_or_empty_pages(page):
    assert main_text(page) in ("", "<", "<p")


def test_deep_pages():
    assert main_text("<div>" * 3000 + f"<p>{LONG}</p>") == LONG


def test_awkward_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", f"<p>{LONG}</p>"), (3, "u", f"<p>{LONG}</p>"), (3, "u", f"<p>{LONG}</p>"), (4, "u", f"<article><p>{LONG * 3000}</p></article>")]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, text string")
    got = extracted(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r.n_chars for r in got.collect()) == sorted([0, 0, len(LONG), len(LONG), len(LONG), len(LONG) * 3000])
    assert extracted(pages.limit(0)).count() == 0


def test_query_gives_the_whole_article(spark):
    sf_dir = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in op7_html_text(spark, sf_dir).collect():
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = re.split("</?(?:p|h1)>", article.replace("<br>", " "))
        want = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", p))).strip() for p in parts]
        assert r.text == " ".join(p for p in want if p) and r.n_chars == len(r.text)


@pytest.mark.parametrize("attr", ['href="/hidden-gems"', 'title="the hidden cost"', 'href="/p?id=comments"', "data-hidden=1", "href=/a/id=menu"])
def test_values_of_other_attributes_hide_nothing(attr):
    page = f"<article><p>Before it, <a {attr}>linked words</a> and after, all of which is long enough to be kept.</p></article>"
    assert "linked words" in main_text(page)


@pytest.mark.parametrize("attr", ["hidden", 'HIDDEN=""', 'title="x" hidden', "Style='display: none'", 'id="comments"'])
def test_own_attributes_hide(attr):
    page = f"<article><p>Before it, <b {attr}>gone</b> and after, all of which is long enough to be kept.</p></article>"
    assert "gone" not in main_text(page)


def test_names_of_articles_parts_hide_nothing():
    body = "<p>" + "A long paragraph, with commas, and words enough to count. " * 4 + "</p>"
    page = f'''<body><nav><a href="/">Home</a></nav><div class="side-effects sidebar-left"><a href="/x">Elsewhere</a></div><article>{body}
      <div class="side-effects"><p>Side effects are rare.</p></div><section id="related-work"><p>Related work exists.</p></section>
      <section class="search-results"><p>Searching helped.</p></section><div class="legal-notice-period"><p>Notice is a month.</p></div>
      <ul class="sources"><li><a href="/1">First source of it</a></li><li><a href="/2">Second source of it</a></li></ul>
      <div class="ad">Buy now</div><div id="comments"><p>First!</p></div></article></body>'''
    text = main_text(page)
    for kept in ("Side effects are rare.", "Related work exists.", "Searching helped.", "Notice is a month.", "First source of it", "Second source of it"):
        assert kept in text
    for gone in ("Home", "Elsewhere", "Buy now", "First!"):
        assert gone not in text
