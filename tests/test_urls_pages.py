"""Edge rows for the URL and page expressions (FIXTURES.md section 3)."""

from pyspark.sql import functions as F

from newsflow.functions import html as H
from newsflow.functions import urls as U
from newsflow.operators import filters as Flt
from newsflow.operators import pages as Pg


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "x string").select(col.alias("y")).first()["y"]


def test_domain_filter(spark):
    rows = [("http://cnn.com/a", True), ("http://edition.cnn.com", True), ("http://notcnn.com", False),
            ("http://cnn.com:443/", False), ("http://u@cnn.com/", False), ("HTTP://CNN.COM", True),
            ("mailto:x@cnn.com", False), ("", False)]
    df = spark.createDataFrame(rows, "url string, want boolean")
    got = df.select("want", U.is_from_any_domain("url", ["cnn.com"]).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_allowlist_matches_expression_and_keeps_rows_once(spark):
    urls = ["http://cnn.com/a", "http://edition.cnn.com/x", "http://notcnn.com/", "http://cnn.com:443/",
            "http://a.b.reuters.com/z", "mailto:x@cnn.com", ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string")
    doms = ["cnn.com", "edition.cnn.com", "reuters.com"]   # nested domains on purpose
    got = sorted(r["id"] for r in Flt.allowlist_semi(df, "url", doms).collect())
    want = sorted(r["id"] for r in df.where(U.is_from_any_domain("url", doms)).collect())
    assert got == want == [0, 1, 4]
    dom_df = spark.createDataFrame([(d,) for d in doms], "domain string")
    got_df = sorted(r["id"] for r in Flt.allowlist_semi(df, "url", dom_df).collect())
    assert got_df == want


def test_path_and_extension(spark):
    df = spark.createDataFrame([("http://h/ARTICLES/x",), ("http://h/a.PDF?x=1",)], "u string")
    r = df.select(U.has_any_path("u", ["/articles/"]).alias("p"),
                  U.has_any_path("u", ["/Articles/"]).alias("p2"),
                  U.has_any_extension("u", [".pdf"]).alias("e")).collect()
    assert [x["p"] for x in r] == [True, False]
    assert [x["p2"] for x in r] == [False, False]
    assert [x["e"] for x in r] == [False, True]


def test_canonical_url(spark):
    cases = {
        "http://h.com/a#frag": "http://h.com/a",
        "http://h.com/a?b=1&a=2": "http://h.com/a",
        "http://h.com": "http://h.com/",
        "HTTP://CNN.COM/Path": "http://cnn.com/Path",
        "http://h.com/é x": "http://h.com/%C3%A9%20x",
        "http://h.com/%C3%A9": "http://h.com/%C3%A9",
        "  http://h.com/a  ": "http://h.com/a",
    }
    for raw, want in cases.items():
        got = one(spark, U.canonical_url(F.col("x")), raw)
        assert got == want, (raw, got)
        assert one(spark, U.canonical_url(F.col("x")), got) == got   # idempotent


def test_outlink_resolution(spark):
    html = ('<a href="/p">1</a><a class=x href="p">2</a><a href="../p">3</a><a href="//h2/p">4</a>'
            '<a href="?q">5</a><a href="#f">6</a><a href="https://abs.org/z">7</a>'
            '<a href="javascript:void(0)">8</a><a name="nohref">9</a><a href="/p">10</a>')
    df = spark.createDataFrame([(1, "http://h.com/dir/page", html)], "page_id int, url string, html string")
    links = [r["link"] for r in Pg.link_candidates(df).orderBy("link_pos").collect()]
    assert links == ["http://h.com/p", "http://h.com/dir/p", "http://h.com/p", "http://h2/p",
                     "http://h.com/dir/page", "http://h.com/dir/page", "https://abs.org/z",
                     "javascript:void(0)", "http://h.com/p"]
    kept = Pg.outlinks(df, ["h.com", "h2"], ["/"]).collect()
    assert sorted(r["link"] for r in kept) == ["http://h.com/dir/p", "http://h.com/dir/page",
                                               "http://h.com/p", "http://h2/p"]


def test_page_parse_edges(spark):
    pages = [
        (1, "<html><p>no title</p></html>"),
        (2, "<title></title><p>x</p>"),
        (3, "<title>A &amp; B</title><title>second</title><p>one<p>two</p>"),
        (4, '<title>t</title><script>var t="</p>";</script><!-- <p>hidden</p> --><p>kept</p>'),
        (5, "<title>t</title><div>no paragraphs</div>"),
        (6, "<title>t</title><p>&amp;lt; x</p>"),
    ]
    raw = spark.createDataFrame([(i, f"h{i}", f"u{i}", h) for i, h in pages],
                                "page_id int, url_hash string, url string, html string")
    parsed, bad = Pg.parse_pages(raw)
    got = {r["page_id"]: (r["title"], r["text"]) for r in parsed.collect()}
    assert [r["page_id"] for r in bad.collect()] == [1]
    assert got[2] == ("", "x")
    assert got[3] == ("A & B", "onetwo")        # unclosed <p> text once; first title
    assert got[4] == ("t", "kept")
    assert got[5] == ("t", "")
    assert got[6][1] == "lt x"                  # &amp;lt; -> "&lt;" then punctuation removed


def test_clean_text_unicode(spark):
    s = "\u00e9 \u00df \u00f1 \u4e2d \u00b2 _ - e\u0301\u00a0x\ty\nz!"
    want = "\u00e9 \u00df \u00f1 \u4e2d \u00b2 _  e\u00a0x\ty\nz"   # combining mark and punctuation go
    assert one(spark, H.clean_text(F.col("x")), s) == want


def test_payload_cut(spark):
    for n in (2199, 2200, 2201):
        text = "a" * 2199 + "😀" + "b" * (n - 2200) if n >= 2200 else "a" * n
        df = spark.createDataFrame([("k", text)], "url_hash string, text string")
        import json
        body = json.loads(Pg.payload(df).first()["body"])["inputs"]
        assert body == text[:2200]


def test_allowlist_plans_as_broadcast_semi_join(spark):
    df = spark.range(1000).select(F.concat(F.lit("http://h"), F.col("id").cast("string"), F.lit(".cnn.com/x")).alias("url"))
    plan = Flt.allowlist_semi(df, "url", Flt.PUBLISHERS)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
