"""Stand-in domain inputs built from the supplied test tables.

These functions only give rows in the schemas the jobs expect; every job
that consumes them works on any data of those schemas. Each rule is
written the same way in the DuckDB oracle (``plans/oracle.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.text import sentences
from ..operators import text as Tx
from ..operators.pages import outlinks
from .tables import read_table

# Fixed values of the bindings.
TEST_DOMAINS = ["example.org", "ththan.example.net", "ample.com"]
LINK_PATHS = ["/d", "/t", "/%c3"]
INDEX_EPOCH = "2024-01-01 00:00:00"
RESULT_EPOCH = "2024-02-01 00:00:00"


def _doc_hash(doc_id) -> F.Column:
    return F.md5(F.concat(F.lit("doc:"), F.col(doc_id).cast("string")))


def _minutes_after(epoch: str, minutes) -> F.Column:
    return F.timestamp_add("MINUTE", minutes, F.to_timestamp_ntz(F.lit(epoch)))


def _summaries(docs: DataFrame) -> DataFrame:
    """(doc_id, summary): the summary job's sentences in order."""
    best = Tx.summarize(docs, k=3).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("_s"))
    return best.select("doc_id", F.array_join(F.transform("_s", lambda x: x["sentence"]), " ").alias("summary"))


def articles(spark: SparkSession, sf_dir: str, summaries: bool = False) -> DataFrame:
    """articles(url_hash, url, title, source, published_date, keywords, tags,
    summary, indexed_at) from ``documents``; title = first sentence, tags =
    [lang, source], summary = the extractive summary where asked for."""
    docs = read_table(spark, sf_dir, "documents")
    # the title is taken before the join, which then carries no texts
    d = docs.select("doc_id", "source", "lang", F.try_element_at(sentences("text"), F.lit(1)).alias("title"))
    d = d.join(_summaries(docs), "doc_id", "left") if summaries else d.withColumn("summary", F.lit(None).cast("string"))
    return d.select(
        _doc_hash("doc_id").alias("url_hash"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"),
                 F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        "title",
        F.col("source"),
        F.lit(None).cast("string").alias("published_date"),
        F.lit(None).cast("array<string>").alias("keywords"),
        F.array("lang", "source").alias("tags"),
        F.col("summary"),
        _minutes_after(INDEX_EPOCH, (F.col("doc_id") * 37) % 1009).alias("indexed_at"),
    )


def article_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article rows as first written by page processing: no tags, no
    summary yet (they arrive later as model results)."""
    return (articles(spark, sf_dir)
            .withColumn("tags", F.lit(None).cast("array<string>"))
            .withColumn("indexed_at", F.lit(None).cast("timestamp_ntz")))


def raw_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader events as received: user header + JSON body {key, event}."""
    e = read_table(spark, sf_dir, "events")
    ev = F.col("event_type")
    mapped = F.when(ev == "purchase", "like").when(ev == "error", "dislike") \
        .when(ev == "view", "read").when(ev == "click", "readmore").otherwise(ev)
    key = F.md5(F.concat(F.lit("doc:"), F.get_json_object("props", "$.k")))
    body = F.to_json(F.struct(key.alias("key"), mapped.alias("event")))
    return e.select("event_id", "ts", F.col("user_id").cast("string").alias("user_id"),
                    body.alias("body"))


def classification_results(spark: SparkSession, sf_dir: str, tasks: DataFrame) -> DataFrame:
    """Classification result objects for the labelled documents:
    (output_location, body JSON array of {label, score}, arrived_at)."""
    lab = read_table(spark, sf_dir, "labels")
    arr = F.array(
        F.struct(F.concat(F.lit("quality:"), F.col("quality").cast("string")).alias("label"),
                 F.lit(1.0).alias("score")),
        F.struct(F.concat(F.lit("toxic:"), F.col("toxic").cast("string")).alias("label"),
                 F.lit(1.0).alias("score")))
    res = lab.select(_doc_hash("doc_id").alias("url_hash"), F.to_json(arr).alias("body"),
                     _minutes_after(RESULT_EPOCH, (F.col("doc_id") * 7) % 1000).alias("arrived_at"))
    return (res.join(tasks.where(F.col("task") == "classification"), "url_hash")
            .select("output_location", "body", "arrived_at"))


def summary_results(spark: SparkSession, sf_dir: str, tasks: DataFrame) -> DataFrame:
    """Summary result objects, [{summary_text}], for every document that the
    summary job finds a sentence in."""
    d = read_table(spark, sf_dir, "documents")
    arr = F.array(F.struct(F.col("summary").alias("summary_text")))
    res = _summaries(d).select(_doc_hash("doc_id").alias("url_hash"), F.to_json(arr).alias("body"),
                   _minutes_after(RESULT_EPOCH, (F.col("doc_id") * 11) % 1000).alias("arrived_at"))
    return (res.join(tasks.where(F.col("task") == "summary"), "url_hash")
            .select("output_location", "body", "arrived_at"))


def crawl_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl records (D2) for the supplied pages: fetched as given, served
    from https (so http URLs are redirected), every eleventh with status
    404; a page without a title fails the way the browser step does."""
    p = read_table(spark, sf_dir, "pages")
    ok = H.has_title("html")
    gone = F.col("page_id") % 11 == 5
    status = F.struct(F.when(gone, 404).otherwise(200).alias("code"), F.when(gone, "Not Found").otherwise("OK").alias("text"))
    content = F.struct(H.title("html").alias("title"), F.col("html").alias("html_content"))
    err = F.struct(F.lit("title not found").alias("err"), F.lit("").alias("trace"))
    return p.select(
        "page_id",
        F.when(ok, status).alias("status"),
        F.when(ok, content).alias("content"),
        F.col("url"),
        F.when(ok, F.regexp_replace("url", "^http://", "https://")).alias("real_url"),
        F.when(~ok, err).alias("err"))


def damaged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages of which every seventh (page_id) arrived without its title."""
    p = read_table(spark, sf_dir, "pages")
    return p.withColumn("html", F.when(F.col("page_id") % 7 == 3, F.regexp_replace("html", H.TITLE_RE, "")).otherwise(F.col("html")))


def based_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages of which every third (page_id) has a base element in front."""
    p = read_table(spark, sf_dir, "pages")
    base = F.concat(F.lit('<base href="/t/'), F.col("page_id").cast("string"), F.lit('/x/">'))
    return p.withColumn("html", F.when(F.col("page_id") % 3 == 1, F.concat(base, "html")).otherwise(F.col("html")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link graph over the pages: the links found in them (inside the test
    domains and paths), and page i to pages (3i+1) mod n and (5i+2) mod n,
    by page_id, so that a walk does not end at once; URLs canonical."""
    p = read_table(spark, sf_dir, "pages").select("page_id", U.canonical_url("url").alias("u"))
    n = p.agg(F.count("*").alias("n"))
    src = p.crossJoin(F.broadcast(n))
    out = src.select(F.col("u").alias("src_url"),
                     F.explode(F.array((F.col("page_id") * 3 + 1) % F.col("n"),
                                       (F.col("page_id") * 5 + 2) % F.col("n"))).alias("dst_id"))
    made = (out.join(p.select(F.col("page_id").alias("dst_id"), F.col("u").alias("dst_url")), "dst_id")
            .select("src_url", "dst_url"))
    links = outlinks(read_table(spark, sf_dir, "pages"), TEST_DOMAINS, LINK_PATHS)
    found = links.join(p, "page_id").select(F.col("u").alias("src_url"), F.col("link").alias("dst_url"))
    return made.unionByName(found)


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds: pages 0, 1, 2; tag = first path segment; seed_pos = page_id."""
    p = read_table(spark, sf_dir, "pages").where(F.col("page_id").isin(0, 1, 2))
    u = U.canonical_url("url")
    return p.select(F.regexp_extract(u, r"^[a-z][a-z0-9+.\-]*://[^/]*/([^/]*)", 1).alias("tag"),
                    u.alias("url"), F.col("page_id").cast("int").alias("seed_pos"))
