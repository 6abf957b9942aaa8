"""Pages and feeds: what is read out of markup that is nested, broken, lazy or hostile."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from issueloom.functions import slices
from issueloom.functions.html import _Page, attributes_of, extract_body, extract_image, read_page
from issueloom.sources import feeds

LONG = "words of a paragraph that is long enough to count, surely"


def body(spark, markup):
    return spark.createDataFrame([(markup,)], "h string").select(extract_body(F.col("h"))).first()[0]


def image(spark, markup, url="https://news.example/a/b.html"):
    return spark.createDataFrame([(markup,)], "h string").select(extract_image(F.col("h"), F.lit(url))).first()[0]


def test_bodies(spark):
    cases = [
        (f'<div data-class="article-body">{LONG}{LONG}</div><div class="x article-body y">{LONG}</div>', LONG),
        (f'<div class="article-bodyx">{LONG}{LONG}</div><p>{LONG}</p>', LONG),
        (f"<div itemprop=articleBody><div>a</div>{LONG}</div>", "a" + LONG),
        (f'<div title="a > b" id=dic_area>{LONG}</div>', LONG),
        (f"<article><p>{LONG}<p>next one</article>", LONG + "next one"),
        (f"<article><b>{LONG}<p>x</b>y</p></article>z", LONG + "xy"),
        (f"<article>{LONG}<nav>menu<div>deep</div></nav><script>if (a < b) '</div>'</script>!</article>", LONG + "!"),
        (f"<article>{LONG}<!-- <article>no</article> --> end</article>", LONG + " end"),
        (f"<article>{LONG} <!-- never closed <p>{LONG}</p></article>", LONG),
        (f"<article>a &lt; b</article><article>{LONG} &lt; c</article><p>{LONG}{LONG} d &gt; e</p>", LONG + LONG + " d > e"),
        (f"<div>{LONG}</div>", ""), ("", ""), (None, ""), ("<", ""), ("<article", ""), ("plain text", ""),
        (f"<table><tr><td><article>{LONG}</td></tr></table>after", LONG),
        (f'<div class="article-body" class="x">{LONG}</div>', LONG),
        (f"<ARTICLE>{LONG}</ARTICLE>", LONG),
        (f"<p>{LONG}</p><p>{LONG} more</p>", LONG + " more"),
    ]
    rows = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, h string")
    got = {r.i: r.b for r in rows.select("i", extract_body(F.col("h")).alias("b")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_images(spark):
    site = "https://news.example"
    cases = [
        ('<article><img data-src="/lazy.png" src="/real.png"></article>', site + "/real.png"),
        ('<article><img alt="x"><img src="/second.png"></article>', ""),
        ('<meta data-content="/no.png" property="og:image" content="/og.png">', site + "/og.png"),
        ('<meta data-property="og:image" content="/no.png"><main><img src=in.png></main>', site + "/a/in.png"),
        ('<meta property="og:image" content=""><meta property="og:image" content="/late.png"><meta name="twitter:image" content="/t.png">',
         site + "/t.png"),
        ('<meta property="og:image" href="/h.png">', site + "/h.png"),
        ('<meta name="twitter:image:src" content="/2.png"><meta name="twitter:image" content="http://127.0.0.1/x.png">', site + "/2.png"),
        ('<link rel="image_src" href="//cdn.example/i.png">', "https://cdn.example/i.png"),
        ('<link rel="image_src"><div class="box news_view"><p><img src="/v.png?a=1&amp;b=2"></p></div>', site + "/v.png?a=1&b=2"),
        ('<div class="news_viewer article-x"><img src="/no.png"></div><img src="/no.png">', ""),
        ("<script>'<main><img src=\"/no.png\"></main>'</script>", ""),
        ('<!-- <meta property="og:image" content="/no.png"> -->', ""),
        (None, ""),
    ]
    rows = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, h string")
    got = {r.i: r.b for r in rows.select("i", extract_image(F.col("h"), F.lit(site + "/a/b.html")).alias("b")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_attributes():
    assert attributes_of(''' A="1" b='2' c = 3 d a=4 e="x > 'y'" f=''') == {
        "a": "1", "b": "2", "c": "3", "d": "", "e": "x > 'y'", "f": ""}


@pytest.mark.parametrize("markup", [
    "<article>" * 30_000, "<div>" * 50_000 + "</p>" * 50_000, "<a" * 200_000, "<a \"" * 100_000, "<p>" * 60_000, "<!--" * 100_000,
    "<p><table>" + "<b>" * 50_000 + "<div>" * 50_000, "<script>" * 50_000, "</div>" * 100_000, "< " * 200_000, "<a b" + " " * 300_000 + ">",
    "<x " + "a" * 300_000, "<article>" + "<p>word " * 40_000])
def test_hostile_pages_are_read_in_time(markup):
    begin = time.time()
    _Page(markup).candidates()
    assert time.time() - begin < 5


RSS = """<?xml version="1.0" encoding="utf-8"?>
<rss xmlns:media="urn:m" xmlns:dc="urn:d"><channel><image><title>no</title></image><title>The <![CDATA[Channel]]></title>
<item><media:title>First title</media:title><title>Second</title><link>https://a.example/1</link><dc:creator>Ann</dc:creator>
  <description>&lt;img src="/d.png"&gt; text</description><enclosure type="image/png" url="/e.png"/><media:thumbnail url="/t.png"/>
  <pubDate>Wed, 10 Jan 2024 10:00:00 GMT</pubDate></item>
<item><TITLE>Two</TITLE><link/><link>https://a.example/no</link></item>
<item><title>Three</title><link href="https://a.example/3"/><media:group><media:content medium="IMAGE" url="/g.png"/></media:group></item>
<item><title>Four</title><link>https://a.example/4</link><author><name>Bo</name></author><media:content url="/untyped.png"/>
  <content><![CDATA[<p><img src='no.png'></p>]]></content></item>
<item><title>Five</title><link>https://a.example/5</link><content><![CDATA[<p><img src='in.png'></p>]]></content></item>
</channel></rss>"""
ATOM = """<feed xmlns="urn:atom"><title>t</title><entry><title>E</title><link href="https://b.example/1"/><summary>s</summary>
<author><name>Cy</name></author><updated>2024-01-09T00:00:00Z</updated></entry><x><entry><title>inner</title></entry></x></feed>"""


def test_feed_files_are_folded_in_document_order(spark, tmp_path):
    for name, text in (("rss", RSS), ("atom", ATOM), ("broken", RSS[:-20]), ("empty", ""), ("other", "<html/>")):
        (tmp_path / f"{name}.xml").write_text(text)
    names = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("feed_file")).select(
        "feed_file", F.concat(F.lit("https://"), F.regexp_extract("feed_file", r"(\w+)\.xml", 1), F.lit(".example/feed")).alias("feed_url"))
    stamp = F.timestamp_seconds(F.lit(0))
    got = {r.url: r for r in feeds.read_feed_files(spark, str(tmp_path), names, stamp).collect()}
    assert set(got) == {"https://a.example/1", "https://a.example/3", "https://a.example/4", "https://a.example/5", "https://b.example/1"}
    one, three, four, atom = (got[f"https://{u}"] for u in ("a.example/1", "a.example/3", "a.example/4", "b.example/1"))
    assert (one.title, one.author, one.source, one.image_url) == ("First title", "Ann", "The Channel", "https://a.example/e.png")
    assert (three.title, three.image_url) == ("Three", "https://a.example/g.png")
    assert (four.author, four.image_url) == ("Bo", "")  # its first element called content is empty
    assert got["https://a.example/5"].image_url == "https://a.example/in.png"
    assert (atom.author, atom.summary, atom.source) == ("Cy", "s", "atom.example")
    assert feeds.read_atom(spark, str(tmp_path), names, stamp).count() == 1
    assert feeds.read_rss(spark, str(tmp_path), names, stamp).count() == 4


def test_pages_are_handed_back_slice_by_slice(spark, monkeypatch):
    monkeypatch.setattr(slices, "SLICE_CHARS", 2000)
    pages = pd.Series([f"<article><p>{'x' * 300}</p><img src='{i}.png'></article>" for i in range(40)])
    out = list(read_page.func(iter([pages])))
    assert max(map(len, out)) < 8 and pd.concat(out)["images"].map(lambda v: v[-1]).tolist() == [f"{i}.png" for i in range(40)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, page string")
    rows = df.select("i", extract_image("page", F.lit("https://a.example/b/")).alias("u")).collect()
    assert all(r.u == f"https://a.example/b/{r.i}.png" for r in rows) and len(rows) == 40
