import html
import re
import time

from pyspark.sql import functions as F

from barloom.llm import lineblocks
from barloom.llm.shared import table

LONG = "This paragraph of the article goes on for a good while, so that it weighs more than any menu line could."


def plain(page):
    """The given pages all hold one article element with blocks h1 and p; found by cutting the string."""
    inner = page.split("<article>")[1].split("</article>")[0]
    blocks = [re.sub(r"<[^>]*(>|$)", " " if "br" in b else "", re.sub(r"<br>", " ", b)) for b in re.split(r"</?(?:h1|p)>", inner)]
    return "\n\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", "", b)).split())))


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.page_id: r for r in lineblocks.op6_line_block_text(spark, sf).collect()}
    for r in table(spark, sf, "pages").collect():
        assert found[r.page_id].text == plain(r.html), r.page_id
        assert found[r.page_id].n_chars == len(found[r.page_id].text) and found[r.page_id].url == r.url


def test_furniture_goes_and_article_stays():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar">
    <div id="cookie-notice"><p>{LONG} cookies</p><button>ok</button></div><header><h2>Site</h2>{LONG}</header><nav><ul><li><a href=x>One</a></ul></nav>
    <div class="content with-sidebar"><article class="post"><header><h1>A &amp; B</h1></header><p>First\n  {LONG} a &lt; b<br>next <a href="#">link</a>.</p>
    <div class="ad"><div>Buy</div>now {LONG}</div><p>x</p><!-- c <p>no</p> --><script>var a = "<p>" + 1 > 2;</script><ul><li>i<li>j</ul><form>{LONG}<input></form><p title="a > b">Last&nbsp;one</article></div>
    <aside>{LONG}</aside><section class="comments"><article><p>{LONG} reader</p></article></section><footer>{LONG}</footer></body></html>"""
    assert lineblocks.main_text(page) == f"A & B\n\nFirst {LONG} a < b next link.\n\nx\n\ni\n\nj\n\nLast one"


def test_pages_without_an_article_element():
    menu = "".join(f"<li><a href='/{i}'>Menu entry {i}</a></li>" for i in range(30))
    page = f"<body><ul>{menu}</ul><div><h2>Head</h2><p>{LONG}<p>short<p>{LONG}</div><ul>{menu}</ul><p>(c) someone</p></body>"
    assert lineblocks.main_text(page) == f"Head\n\n{LONG}\n\nshort\n\n{LONG}"
    assert lineblocks.main_text("<body><p>tiny</p></body>") == ""


def test_broken_pages():
    assert lineblocks.main_text(f"<article><p>{LONG}<p>cut <a hre") == f"{LONG}\n\ncut"
    assert lineblocks.main_text(f"<article><p>{LONG} &am") == f"{LONG} &am"
    assert lineblocks.main_text(f"<article><p>{LONG}</p><script>never closed <p>x") == LONG
    assert lineblocks.main_text("<article><p>a <3 b < c</article>") == "a <3 b < c"
    for bad in (None, "", "<", "<!--", "<article>", "plain", "<p", "</div></article>", "<a href='", '<div class="'):
        assert lineblocks.main_text(bad) == ""
    start = time.time()
    for bad in ("<" * 200_000, "<!--" * 100_000, "<div>" * 100_000, "<a '" * 100_000, "&" * 300_000, "<script>" * 50_000, "<p>x" * 100_000, "<div class=ad>" * 50_000, "<article>" * 50_000 + "x"):
        lineblocks.main_text(bad)
    assert time.time() - start < 30


def test_nulls_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, None, None), (None, "u", f"<article>{LONG}</article>"), (1, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit(3)).withColumn("n_chars", F.lit("x"))
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in lineblocks.extract(rows).collect()) == [(0, "u", LONG, len(LONG)), (1, "", "", 0), (1, "v", "", 0)]
    assert lineblocks.extract(rows.limit(0)).count() == 0
