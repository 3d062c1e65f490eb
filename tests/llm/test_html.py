"""Main texts of the given pages, of hand-made layouts, and of broken markup."""

import re
from html import unescape

import pytest

from siteweave.llm import html
from siteweave.llm.queries import op9_main_text

LONG = "This paragraph holds the story and goes on for a good while, as such paragraphs do. "


def article(page):
    """The article of a generated page by cutting its source text."""
    source = re.search("<article>(.*?)</article>", page, re.S)[1]
    source = re.sub(r"</?(?:p|h1)>", "\0", re.sub("<br>", " ", re.sub("<!--.*?-->", "", source, flags=re.S)))
    source = re.sub(r"</?[a-z][^>]*>", "", source)
    return "\n".join(b for b in (" ".join(unescape(x).split()) for x in source.split("\0")) if b)


def test_given_pages(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = op9_main_text(spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article(pages[r["page_id"]]["html"])
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


LAYOUTS = {
    "div": f"<body><div id='top-nav'><a href=/>Home</a></div><div class=content><h2>Title</h2><p>{LONG}<p>{LONG}<a href=x>link</a> end</div><div class='sidebar-left'><p>{LONG}</p></div></body>",
    "header": f"<header><h1>Site</h1></header><main><h2>Title</h2><p>{LONG}</p><p>{LONG}<a href=x>link</a> end</p></main><footer>{LONG}</footer>",
    "noise inside": f"<article><h2>Title</h2><p>{LONG}<div class='advert'>{LONG}</div><form>{LONG}<input></form><p>{LONG}<a href=x>link</a> end<section id=comments><p>{LONG}</section><script>var a='<p>';</script></article>",
    "unclosed": f"<div class='cookie-notice'>{LONG}</div><article><h2>Title<p><b>{LONG}<br><p>{LONG}<a href=x>link</a> end",
    "roles": f"<div role=navigation>{LONG}{LONG}{LONG}</div><div><h2>Title</h2><p>{LONG}</p><p>{LONG}<a href=x>link</a> end</p></div><div role='contentinfo'>{LONG}</div>",
    "sections": f"<div><section><h2>Title</h2><p>{LONG}</p></section><section><p>{LONG}<a href=x>link</a> end</p></section></div><aside>{LONG}</aside>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert html.main_text(LAYOUTS[name]) == f"Title\n{LONG.strip()}\n{LONG}link end"


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("<!-- only -->", ""),
        ("<nav>menu</nav>", ""),
        ("plain  text\n< 5 &amp; &lt;b&gt; &#233;&nbsp;x", "plain text < 5 & <b> é x"),
        ("<article><p>a&nbsp; b\n c</p>tail<ul><li>one<li>two</ul></article>", "a b c\ntail\none\ntwo"),
        ("<article><pre>x\n  y</pre><table><tr><td>1<td>2<tr><td>3</table></article>", "x y\n1\n2\n3"),
        ("<article>a<style>p{}</style>b<script>if (a<b) x('</p>')</script>c<!-- d --></article>", "abc"),
        ("<article title=\"a>b\" data-x='>'>in</article>", "in"),
        ("<article><p>open <b>bold <i>both</p><p>next</article>", "open bold both\nnext"),
        ("<article>cut <p class=", "cut"),
        ("<article>cut <!-- never", "cut"),
        ("<article>cut <script>never", "cut"),
    ],
)
def test_odd_pages(page, expected):
    assert html.main_text(page) == expected


def test_deep_and_long_pages():
    assert html.main_text("<div>" * 50_000 + "deep" + "</div>" * 10) == "deep"
    text = "\n".join(f"{LONG.strip()} {i}" for i in range(3000))
    assert html.main_text("<article>" + "".join(f"<p>{t}</p>" for t in text.split("\n")) + "</article>") == text


def test_table_of_odd_rows(frame, compare):
    rows = [(1, "u", "<article>a</article>", "x"), (1, "u", "<article>a</article>", "x"), (None, None, None, None), (2, None, "", "x")]
    got = html.extract(frame(rows, "page_id long, url string, html string, text string")).collect()
    compare(got, [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, None, "", 0)])
    assert html.extract(frame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize(
    "start, end",
    [("<div class='layout has-sidebar'>", "</div>"), ("<div class=no-comments>", "</div>"), ("<div id='menu-open'><div class='widget-content'>", "</div></div>"), ("<form action=x>", "</form>")],
)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_marked_wrappers_keep_the_article(start, end, tag):
    page = f"<body>{start}<div class=sidebar>side words</div><{tag}><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></{tag}>{end}</body>"
    assert html.main_text(page) == f"Title\n{LONG.strip()}\n{LONG.strip()}"


@pytest.mark.parametrize(
    "page, expected",
    [
        (f"<main><article><p>{LONG}<p>{LONG}</article><article><p>part two</article></main>", [LONG, LONG, "part two"]),
        (f"<main><article><p>{LONG}<p>{LONG}</article><section>rest</section></main>", [LONG, LONG, "rest"]),
        (f"<div><article><p>{LONG}<p>{LONG}</article><article><p>{LONG}{LONG}<p>{LONG}</article></div>", [LONG, LONG, LONG + LONG, LONG]),
        (f"<body>Intro <b>bold</b> text<div><p>{LONG}</p><p>{LONG}</p></div></body>", ["Intro bold text", LONG, LONG]),
        (f"<article><p>{LONG}<p>so <math><mi>x</mi></math> is <noscript>y</noscript></article>", [LONG, "so x is y"]),
    ],
)
def test_no_part_of_the_article_is_lost(page, expected):
    assert html.main_text(page) == "\n".join(e.strip() for e in expected)
