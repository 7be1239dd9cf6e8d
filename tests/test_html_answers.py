"""Links, references and URLs against answers written by hand (not derived
from the expressions or their SQL)."""

import pytest
from pyspark.sql import functions as F

from newsflow.functions import html as H
from newsflow.functions import urls as U
from newsflow.operators import pages as Pg

ANCHORS = """
<a href='/single'>x</a> <a href=/bare>x</a> <a href = "/spaced">x</a> <A CLASS="b" HREF="/upper">x</A>
<a data-href="/data">x</a> <!-- <a href="/comment">x</a> --> <script>var s = '<a href="/script">';</script>
<style>a:after { content: '<a href="/style">' }</style> <a title="a > b" href="/after-quote">x</a>
<a href="/q?a=1&amp;copy=2&copy=3#f">x</a> <a name="none">x</a> <a href>x</a> <a/href="/slash">x</a>
<area href="/area"> <abbr href="/abbr">x</abbr> <a
href="/line">x</a> <a href="/first" href="/second">x</a> <a href="/a&#47;b&#x2F;c">x</a> <a href=" /blank&#9;s ">x</a>
"""


def test_anchor_links(spark):
    df = spark.createDataFrame([(1, "http://h.com/d/p", ANCHORS)], "page_id int, url string, html string")
    got = [r.link for r in Pg.link_candidates(df).orderBy("link_pos").collect()]
    assert got == ["http://h.com" + p for p in (
        "/single", "/bare", "/spaced", "/upper", "/after-quote", "/q", "/d/p", "/slash", "/line", "/first", "/a/b/c", "/blanks")]


@pytest.mark.parametrize("raw, want", [
    ("caf&eacute; it&#8217;s", "café it’s"), ("&lt;b&gt; &amp;amp; &quot;&apos;&#39;&#x27;", "<b> &amp; \"'''"),
    ("&nbsp;|&copy;|&copy|&hellip;", " |©|©|…"), ("&unknown; & &; &#; a&b", "&unknown; & &; &#; a&b"),
    ("&#128;&#x80;&#0;&#xD800;&#1114112;&#99999999999;", "€€����"), ("&#128512;&#x1F600", "😀😀"),
    ("&NotEqualTilde;", "≂̸"), ("&amp;lt;", "&lt;"), ("", ""), (None, None),
])
def test_references(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "x string").select(H.unescape("x").alias("y")).first().y
    assert got == want


def test_titles_and_paragraphs(spark):
    page = "<!-- <title>no</title> --><title>Caf&eacute; &#8217;s</title><p>caf&eacute; it&#8217;s &mdash; ok</p>"
    r = spark.createDataFrame([(page,)], "x string").select(
        H.title("x").alias("t"), H.clean_text(H.paragraph_text("x")).alias("p")).first()
    assert (r.t, r.p) == ("Café ’s", "café its  ok")
    bad = spark.createDataFrame([("<script>'<title>x</title>'</script>",)], "x string")
    assert not bad.select(H.has_title("x").alias("y")).first().y


@pytest.mark.parametrize("raw, want", [
    ("http://h.com/a b?x\ny", "http://h.com/a%20b"), ("\thttp://h.com/a\n", "http://h.com/a"),
    ("http://h.com/a\nb\tc\r", "http://h.com/abc"), ("\x00 http://h.com/\x1f ", "http://h.com/"),
    ("HTTP://H.com?x#\n", "http://h.com/"),
])
def test_canonical_urls(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "x string").select(U.canonical_url(F.col("x")).alias("y")).first().y
    assert got == want


def test_seeds_are_compared_canonically(spark):
    good = spark.createDataFrame([(1, "http://seed.example.org/start", ("t", "<p>"), None), (2, "http://x.example.org/", ("t", "<p>"), None)],
                                 "page_id int, url string, content struct<title:string,html_content:string>, real_url string")
    seeds = spark.createDataFrame([("http://Seed.example.org/start#x",)], "url string")
    assert [r.url for r in Pg.content_store(good, seeds, ["example.org"]).collect()] == ["http://x.example.org/"]


@pytest.mark.parametrize("head, want", [
    ("", ["http://h.com/d/a", "http://h.com/b", "http://o.com/c"]),
    ('<base href="/x/y/">', ["http://h.com/x/y/a", "http://h.com/b", "http://o.com/c"]),
    ("<BASE target=_top><base\n href='http://cdn.net/r/s?q'><base href=/later/>", ["http://cdn.net/r/a", "http://cdn.net/b", "http://o.com/c"]),
    ('<base href="../up/">', ["http://h.com/up/a", "http://h.com/b", "http://o.com/c"]),
    ('<base href="//n.org/z&#47;">', ["http://n.org/z/a", "http://n.org/b", "http://o.com/c"]),
    ('<!-- <base href="/no/"> --><script>"<base href=/no/>"</script>', ["http://h.com/d/a", "http://h.com/b", "http://o.com/c"]),
    ('<base href="mailto:x@y.z">', ["http://h.com/d/a", "http://h.com/b", "http://o.com/c"]),
    ('<basefont href="/no/"><base>', ["http://h.com/d/a", "http://h.com/b", "http://o.com/c"]),
    ('<base href="">', ["http://h.com/d/a", "http://h.com/b", "http://o.com/c"]),
])
def test_base_elements(spark, head, want):
    page = head + '<a href="a">1</a><a href="/b">2</a><a href="http://o.com/c">3</a>'
    df = spark.createDataFrame([(1, "http://h.com/d/p?q#f", page)], "page_id int, url string, html string")
    assert [r.link for r in Pg.link_candidates(df).orderBy("link_pos").collect()] == want
