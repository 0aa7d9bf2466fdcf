"""Main texts against hand-written pages, a plain reading of the shipped ones, and broken markup."""

from __future__ import annotations

import html
import re
import time

import pytest

from tessera.llm import queries, webpages
from tessera.llm.webpages import Page

SF = "/root/testdata/sf0.001"

FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><div id="cookie-notice">We use cookies</div>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="wrap"><aside>aside words</aside>
<div class="post-content post-17"><header class="entry-header"><h1>The   title</h1></header><p>First &lt;para&gt; &amp; more<br>next <script>var x="</p>";</script>
<p>Second&nbsp;one<ul><li>one<li>two</ul><form><input><button>Send</button>form words</form><div class="ad-slot">buy</div>
<table><tr><td>c1<td>c2<tr><td>c3</table>tail</div>
<section id="comments"><h1>Comments</h1><article><p>a comment that is much longer than the article itself, so that its size alone would make it win the page</p></article></section></div>
<footer>foot</footer></body></html>"""


def test_full_page():
    assert Page(FULL).text(None) == "The title\nFirst <para> & more next\nSecond one\none\ntwo\nc1\nc2\nc3\ntail"


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<", "<"), ("plain &amp; <b>bold</b>", "plain & bold"), ("<p>no body</p>", "no body"), ("<body>plain &amp; <b>bold</b>", "plain & bold"), ("<body><p>a<p>b", "a\nb"),
    ("<body><div class=ad>x<div class=content><h1>t</h1>y</div>", "t\ny"), ("<body><form><div class='post'><h1>t</h1><p>long words</p></div></form>", "t\nlong words"), ("<body><!-- a <p>b --><p>c</p><!-- d", "c"),
    ("<body><p title='a > b'>x</p><p>1 < 2</p>", "x\n1 < 2"), ("<body><title>never closed<p>x", "never closed\nx"), ("<body><script>never closed<p>x", ""), ("<body><a href=1>one<a href=2>two</a><p>three words here", "onetwo\nthree words here"),
])
def test_small_pages(page, text):
    assert Page(page).text(None) == text


def test_long_broken_pages_take_linear_time():
    for junk in ("<div>" * 20_000 + "x", "<p>" * 20_000, "<a '" * 50_000, "<a \"" * 50_000 + ">", "</div>" * 20_000, "<" * 100_000, "<!--" * 50_000, "<script>" * 20_000, "<b>" * 20_000 + "<div>t"):
        began = time.time()
        Page(junk).votes()
        Page(junk).text(None)
        assert time.time() - began < 5, junk[:20]


def test_shipped_pages(spark):
    """The articles of the shipped pages, cut at block tags by a pattern."""
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
        want[r.page_id] = "\n".join(x for x in lines if x)
    got = queries.op11_html_extraction(spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got) and len(got) == len(want)


def test_consensus(spark):
    """A page whose own best container is a long teaser list is read along the path that its host's other pages agree on."""
    good = "<body><div class='story s{0}'><h1>h{0}</h1><p>{1}</p></div><div class='box'><p>short</p></div></body>"
    rows = [(i, f"http://A.example/{i}", good.format(i, "words of the story " * 20)) for i in range(40)]
    rows.append((99, "http://a.example:80/x", good.format(99, "few words").replace("short", "words of the teaser " * 8)))
    rows += [(100, None, "<body><div class='box'><p>alone</p></div>"), (101, "nonsense", None), (102, "http://b.example", ""), (102, "http://b.example", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r for r in webpages.extract(df).selectExpr("row.page_id as id", "host", "path", "text", "n_chars").collect()}
    assert got[99].text == "h99\nfew words" and got[99].path == got[0].path and got[0].host == "a.example"
    assert Page(rows[40][2]).text(None) != got[99].text
    assert got[100].text == "alone" and got[101].text == "" and got[102].n_chars == 0


def test_clashing_names_and_nothing(spark):
    df = spark.createDataFrame([(1, "http://h/x", "<body><p>t</p>", "r", 1)], "page_id long, url string, html string, row string, `a.b` int").selectExpr("*", "url as host", "html as path", "page_id as n_pages")
    assert [r.text for r in webpages.extract(df).collect()] == ["t"]
    assert webpages.extract(df.limit(0)).count() == 0
