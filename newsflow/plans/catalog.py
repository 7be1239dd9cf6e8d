"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the supplied tables (through ``sources.bindings``) and
runs the library's operators over the whole tables. Array columns are
given out as comma-joined strings so the DuckDB oracle can compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import history as Hst
from ..operators import recommend as Rec
from ..session import materialize, scratch_path
from ..sources import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

COUNTER_CUTOFF = "2024-01-15 00:00:00"


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def flat(df: DataFrame, sort_arrays: tuple[str, ...] = ()) -> DataFrame:
    """Arrays of strings -> comma-joined strings (sorted where asked)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_sort(F.col(f.name)) if f.name in sort_arrays else F.col(f.name)
            cols.append(F.array_join(c, ",").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------- E2 history
def _raw_events(spark, sf):
    return Hst.parse_history(B.raw_history(spark, sf))


def _events(spark, sf):
    return Hst.dispatch(_raw_events(spark, sf))


@register
def history_events(spark, sf):
    return _events(spark, sf)


@register
def user_tag_counts(spark, sf):
    return Hst.user_tag_counts(_events(spark, sf), B.articles(spark, sf))


@register
def global_total(spark, sf):
    return Hst.global_total(_events(spark, sf), B.articles(spark, sf))


@register
def tag_catalog(spark, sf):
    return Hst.tag_catalog(_events(spark, sf), B.articles(spark, sf))


@register
def liked_state(spark, sf):
    return Hst.liked_state(_events(spark, sf))


@register
def counter_apply(spark, sf):
    """Counters stored from the events before the cutoff, then the deltas
    of the later events applied on top (A8)."""
    ev, art = _events(spark, sf), B.articles(spark, sf)
    cut = F.to_timestamp_ntz(F.lit(COUNTER_CUTOFF))
    stored = Hst.user_tag_counts(ev.where(F.col("ts") < cut), art)
    deltas = Hst.user_tag_counts(ev.where(F.col("ts") >= cut), art)
    return Hst.apply_counter_deltas(stored, deltas)


# ---------------------------------------------------------------- E3 recommend
def _interest(spark, sf):
    ev, art = _events(spark, sf), B.articles(spark, sf)
    return Rec.interest(Hst.user_tag_counts(ev, art), None, Hst.global_total(ev, art))


@register
def interest(spark, sf):
    return _interest(spark, sf)


@register
def top_tags(spark, sf):
    return Rec.top_tags(_interest(spark, sf))


@register
def tag_match_top30(spark, sf):
    ev, art = _events(spark, sf), B.articles(spark, sf)
    hits = Rec.tag_match_top(art, Hst.tag_catalog(ev, art), k=30)
    return hits.select("tag", "pos", "url_hash", "score")


def _recommend(spark, sf):
    art = B.articles(spark, sf)
    return Rec.recommend(Rec.top_tags(_interest(spark, sf)), art, Hst.users(_raw_events(spark, sf)))


@register
def recommend(spark, sf):
    return flat(_recommend(spark, sf))


@register
def recommend_unread(spark, sf):
    recs = Rec.remove_read(_recommend(spark, sf), Hst.read_articles(_events(spark, sf)))
    return flat(recs)


@register
def trending(spark, sf):
    return flat(Rec.latest(B.articles(spark, sf), 20))


@register
def summary_view(spark, sf):
    raw = _raw_events(spark, sf)
    requests = raw.select("user_id", F.col("url_hash").alias("key")).distinct()
    return flat(Rec.summary_view(requests, B.articles(spark, sf, summaries=True), Hst.liked_state(Hst.dispatch(raw))))


@register
def scan_limit(spark, sf):
    return Rec.scan_limit(B.articles(spark, sf), 10)


# ---------------------------------------------------------------- URLs, pages
from ..operators import filters as Flt  # noqa: E402
from ..operators import pages as Pg  # noqa: E402
from ..sources.tables import read_table  # noqa: E402

PAGE_PATHS = ["/en/", "/de/"]
PAGE_EXTENSIONS = [".html"]


def _pages(spark, sf):
    return Pg.canonicalize(read_table(spark, sf, "pages"))


def _raw_pages(spark, sf):
    """raw_pages(url_hash, url, html) as the content store holds them."""
    return _pages(spark, sf).select("page_id", "url_hash", F.col("canonical_url").alias("url"), "html")


def _parsed(spark, sf):
    parsed, _ = Pg.parse_pages(_raw_pages(spark, sf))
    return parsed


@register
def pages_canonical(spark, sf):
    return _pages(spark, sf).select("page_id", "url", "canonical_url", "url_hash")


@register
def domain_filter(spark, sf):
    p = _pages(spark, sf).select("page_id", "canonical_url")
    return Flt.domain_filter(p, "canonical_url", B.TEST_DOMAINS)


@register
def path_filter(spark, sf):
    p = _pages(spark, sf).select("page_id", "canonical_url")
    return Flt.path_filter(p, "canonical_url", PAGE_PATHS)


@register
def extension_filter(spark, sf):
    p = _pages(spark, sf).select("page_id", "canonical_url")
    return Flt.extension_filter(p, "canonical_url", PAGE_EXTENSIONS)


@register
def allowlist_save(spark, sf):
    p = _pages(spark, sf).select("page_id", "canonical_url")
    return Flt.allowlist_semi(p, "canonical_url", B.TEST_DOMAINS)


@register
def outlinks(spark, sf):
    return Pg.outlinks(read_table(spark, sf, "pages"), B.TEST_DOMAINS, B.LINK_PATHS)


@register
def outlinks_based(spark, sf):
    """Links of pages of which a third has a base element."""
    return Pg.outlinks(B.based_pages(spark, sf), B.TEST_DOMAINS, B.LINK_PATHS)


@register
def outlink_counts(spark, sf):
    return Pg.outlink_counts(Pg.outlinks(read_table(spark, sf, "pages"), B.TEST_DOMAINS, B.LINK_PATHS))


@register
def page_parse(spark, sf):
    return _parsed(spark, sf)


@register
def clean_text(spark, sf):
    from ..functions.html import clean_text as clean
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", clean("text").alias("text_clean"))


@register
def payload(spark, sf):
    return Pg.payload(_parsed(spark, sf))


@register
def quarantine_split(spark, sf):
    good, bad = Flt.quarantine_split(B.crawl_output(spark, sf))
    g = good.select("page_id", F.lit("good").alias("part"), F.col("status.code").alias("status_code"),
                    F.col("content.title").alias("title"), F.lit(None).cast("string").alias("err"))
    q = bad.select("page_id", F.lit("quarantine").alias("part"), F.lit(None).cast("int").alias("status_code"),
                   F.lit(None).cast("string").alias("title"), F.col("err.err").alias("err"))
    return g.unionByName(q)


@register
def content_store(spark, sf):
    good, _ = Flt.quarantine_split(B.crawl_output(spark, sf))
    return Pg.content_store(good, B.seeds(spark, sf), B.TEST_DOMAINS)


@register
def url_dedup(spark, sf):
    cands = Pg.link_candidates(read_table(spark, sf, "pages"))
    return Pg.first_visits(cands, "link", ["page_id", "link_pos"])


# ---------------------------------------------------------------- article assembly
from ..operators import articles as Art  # noqa: E402
from ..operators import keyed_table as Kt  # noqa: E402


def _tasks(spark, sf):
    return Art.inference_tasks(B.article_stubs(spark, sf))


@register
def inference_tasks(spark, sf):
    return _tasks(spark, sf)


@register
def extract_tags(spark, sf):
    res = B.classification_results(spark, sf, _tasks(spark, sf))
    return flat(Art.extract_tags(res).select("output_location", "tags"))


@register
def result_to_article(spark, sf):
    tasks = _tasks(spark, sf)
    res = Art.extract_tags(B.classification_results(spark, sf, tasks))
    return flat(Art.result_to_article(res, tasks, B.article_stubs(spark, sf))
                .select("url_hash", "title", "task", "tags"))


@register
def metadata_merge(spark, sf):
    tasks = _tasks(spark, sf)
    merged = Art.metadata_merge(B.article_stubs(spark, sf), B.classification_results(spark, sf, tasks),
                                B.summary_results(spark, sf, tasks), tasks)
    return flat(merged.select("url_hash", "title", "tags", "summary", "indexed_at"))


@register
def upsert_replace(spark, sf):
    """Re-processed pages (the labelled documents) rewrite their whole row,
    wiping tags and summary until the results are back (V3)."""
    # the upsert reads its rows twice: keys first, then whole
    base = materialize(B.articles(spark, sf, summaries=True), "articles")
    labelled = read_table(spark, sf, "labels").select(
        F.md5(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("url_hash"))
    updates = B.article_stubs(spark, sf).join(labelled, "url_hash", "left_semi")
    out = Art.upsert_replace(base, updates)
    return flat(out.select("url_hash", "title", "tags", "summary"))


@register
def upsert_merge(spark, sf):
    """Classification results patched into the full article rows."""
    tasks = _tasks(spark, sf)
    res = Art.extract_tags(B.classification_results(spark, sf, tasks))
    patch = res.join(tasks, "output_location").select("url_hash", "tags")
    out = Art.upsert_merge(B.articles(spark, sf, summaries=True), patch)
    return flat(out.select("url_hash", "title", "tags", "summary"))


BUCKETS = 64


def _article_table(spark, sf, name):
    """The article rows with summaries as version 0 of a keyed table."""
    base = B.articles(spark, sf, summaries=True)
    table = Kt.KeyedTable(spark, scratch_path(spark, name), "url_hash", base.schema, BUCKETS)
    Kt.replace_into(table, 0, base)
    return table


@register
def upsert_replace_bucketed(spark, sf):
    """``upsert_replace`` as a new version of a table that rewrites the
    buckets of the re-processed pages; the repeated write changes nothing."""
    table = _article_table(spark, sf, "articles-replace")
    labelled = read_table(spark, sf, "labels").select(
        F.md5(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("url_hash"))
    updates = B.article_stubs(spark, sf).join(labelled, "url_hash", "left_semi")
    for _ in range(2):
        Kt.replace_into(table, 1, updates)
    return flat(table.read().select("url_hash", "title", "tags", "summary"))


@register
def upsert_merge_bucketed(spark, sf):
    """``upsert_merge`` as two versions: the results of even and odd minutes."""
    table = _article_table(spark, sf, "articles-merge")
    tasks = _tasks(spark, sf)
    res = Art.extract_tags(B.classification_results(spark, sf, tasks))
    patch = res.join(tasks, "output_location").select("url_hash", "tags", (F.minute("arrived_at") % 2).alias("half"))
    for half in (0, 1):
        Kt.merge_into(table, half + 1, patch.where(F.col("half") == half).drop("half"))
    return flat(table.read().select("url_hash", "title", "tags", "summary"))


@register
def page_to_article(spark, sf):
    """The newest parsed page of each URL with keywords, payload and the
    places of its two model results."""
    from ..operators import text as Tx
    # both are read several times below, and pages are parsed once
    parsed = materialize(_parsed(spark, sf), "parsed")
    empty = spark.createDataFrame([], parsed.schema)
    newest = materialize(Art.upsert_replace(empty, parsed, order_col="page_id"), "newest")
    keywords = Tx.keywords_tfidf(newest, "url_hash", "text", top_n=10)
    return flat(Art.page_articles(newest, keywords).drop("page_id"))


# ---------------------------------------------------------------- graph
from ..operators import frontier as Fr  # noqa: E402

CRAWL_BUDGET = 500


def _frontier(spark, sf):
    return Fr.bfs_frontier(B.seeds(spark, sf), B.edges(spark, sf), max_visits=CRAWL_BUDGET)


@register
def frontier(spark, sf):
    return _frontier(spark, sf)


@register
def frontier_tags(spark, sf):
    return _frontier(spark, sf).select("url", "tag")


@register
def frontier_redirects(spark, sf):
    """Three levels of the walk, without a budget, in which the redirect
    target of a visited page counts as seen."""
    good, _ = Flt.quarantine_split(B.crawl_output(spark, sf))
    return Fr.bfs_frontier(B.seeds(spark, sf), B.edges(spark, sf), max_visits=None, max_depth=3,
                           aliases=Fr.redirects(good))


@register
def frontier_redirects_whole(spark, sf):
    """The same walk to its end: neither a budget nor a depth."""
    good, _ = Flt.quarantine_split(B.crawl_output(spark, sf))
    return Fr.bfs_frontier(B.seeds(spark, sf), B.edges(spark, sf), max_visits=None, aliases=Fr.redirects(good))


@register
def redirect_alias(spark, sf):
    good, _ = Flt.quarantine_split(B.crawl_output(spark, sf))
    return Fr.seen_with_redirects(good)


@register
def seen_anti(spark, sf):
    good, _ = Flt.quarantine_split(B.crawl_output(spark, sf))
    stored = Pg.content_store(good, B.seeds(spark, sf), B.TEST_DOMAINS)
    return Fr.unseen(B.edges(spark, sf).select(F.col("dst_url").alias("url")), stored)


@register
def seen_runs(spark, sf):
    """The unseen URLs of two runs: version 0 holds the stored pages, the
    first run meets the links of even pages, the second all links again."""
    good, _ = Flt.quarantine_split(B.crawl_output(spark, sf))
    seen = Kt.SeenSet(spark, scratch_path(spark, "seen"), buckets=BUCKETS)
    seen.add(0, Pg.content_store(good, B.seeds(spark, sf), B.TEST_DOMAINS).select("url_hash"))
    links = materialize(B.edges(spark, sf).select(F.md5("src_url").alias("src"), F.md5("dst_url").alias("url_hash"),
                                                  F.col("dst_url").alias("url")), "links")
    even = F.conv(F.substring("src", 32, 1), 16, 10).cast("int") % 2 == 0
    runs = [seen.add(1, links.where(even)), seen.add(2, links)]
    return runs[0].unionByName(runs[1]).join(links.select("url_hash", "url").distinct(), "url_hash")


# ---------------------------------------------------------------- text jobs
from ..operators import scoring as Sc  # noqa: E402
from ..functions.text import tokens  # noqa: E402
from ..operators import text as Tx  # noqa: E402


@register
def keywords_tfidf(spark, sf):
    return Tx.keywords_tfidf(read_table(spark, sf, "documents"), top_n=10)


@register
def summarize(spark, sf):
    return Tx.summarize(read_table(spark, sf, "documents"), k=3)


@register
def summarize_reweighted(spark, sf):
    """Summaries in which the words of a chosen sentence count less after it."""
    return Tx.summarize(read_table(spark, sf, "documents"), k=3, reweight=True)


def _nb_model(spark, sf):
    """Naive Bayes (class = quality), trained on the labelled documents except
    every fifth, which is held out."""
    labelled = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id").where(F.col("doc_id") % 5 != 0)
    return Tx.nb_train(labelled, "quality")


@register
def classify_nb(spark, sf):
    """The best class of every document."""
    return Tx.nb_classify(read_table(spark, sf, "documents"), _nb_model(spark, sf))


@register
def classify_scores(spark, sf):
    """The scores of all classes of every document, best first."""
    scored = Tx.nb_scores(read_table(spark, sf, "documents"), _nb_model(spark, sf))
    return scored.select("doc_id", F.posexplode("labels").alias("p", "l")).select(
        "doc_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("l.label").alias("label"), F.col("l.score").alias("score"))


@register
def keywords_mmr(spark, sf):
    return Tx.keywords_mmr(read_table(spark, sf, "documents"), candidates=20, top_n=10, diversity=0.7)


@register
def keywords_maxsum(spark, sf):
    return Tx.keywords_maxsum(read_table(spark, sf, "documents"), candidates=20, top_n=10)


@register
def score_batches(spark, sf):
    return Sc.score_batches(_parsed(spark, sf), Sc.length_model,
                            "url_hash string, n_chars bigint, label string")


@register
def score_labels(spark, sf):
    """The payloads of all documents scored by the resident naive Bayes model,
    in a run that is stopped after half of its parts and started again. The
    weights of a payload's tokens come with it, whatever the vocabulary."""
    model = _nb_model(spark, sf)
    load = Sc.naive_bayes_scorer(model, weighed=True)
    docs = read_table(spark, sf, "documents")
    payload = tokens(F.substring(F.coalesce("text", F.lit("")), 1, 2200))
    docs = materialize(Tx.nb_weighed(docs, model, payload, "weighed"), "weighed")
    args = dict(outputs="pred int, score double", path=scratch_path(spark, "scored"), key_col="doc_id", inputs="weighed", parts=4)
    Sc.score_resumable(docs, load, only=(0, 1), **args)
    return Sc.score_resumable(docs, load, **args)[0]


# ---------------------------------------------------------------- streams
from ..streaming import jobs as X  # noqa: E402

STREAM_FILES = 4


@register
def stream_history_counts(spark, sf):
    src = X.stage_files(B.raw_history(spark, sf), "x2-in", STREAM_FILES)
    return X.stream_history_counts(spark, src, B.articles(spark, sf))


@register
def stream_liked_state(spark, sf):
    src = X.stage_files(B.raw_history(spark, sf), "x5-in", STREAM_FILES)
    return X.stream_liked_state(spark, src)


@register
def stream_page_parse(spark, sf):
    pages = read_table(spark, sf, "pages")
    src = X.stage_files(pages, "x1-in", STREAM_FILES)
    return X.stream_page_parse(spark, src, pages.schema)[0]


@register
def stream_quarantine(spark, sf):
    """The pages of the parsing stream that have no title, with message and trace."""
    pages = B.damaged_pages(spark, sf)
    src = X.stage_files(pages, "x1-in", STREAM_FILES)
    return X.stream_page_parse(spark, src, pages.schema)[1]


@register
def stream_html_files(spark, sf):
    """The pages as loose HTML objects, written out and streamed in."""
    pages = _pages(spark, sf)
    src = X.stage_objects(pages, "page_id", "html", "html-objects")
    urls = pages.select(F.col("page_id").cast("string").alias("key"), "page_id", "url_hash", F.col("canonical_url").alias("url"))
    return X.stream_html_files(spark, src, urls, key_re="page_id=([0-9]+)/")[0]


@register
def stream_result_files(spark, sf):
    """The classification results as loose JSON objects."""
    res = B.classification_results(spark, sf, _tasks(spark, sf))
    src = X.stage_objects(res, "output_location", "body", "result-objects")
    return flat(X.stream_result_files(spark, src, key_re="output_location=([^/]+)/")[0])


@register
def stream_result_merge(spark, sf):
    tasks = _tasks(spark, sf)
    cdir = X.stage_files(B.classification_results(spark, sf, tasks), "x3-class", STREAM_FILES)
    sdir = X.stage_files(B.summary_results(spark, sf, tasks), "x3-summary", STREAM_FILES)
    merged = X.stream_result_merge(spark, B.article_stubs(spark, sf), cdir, sdir, tasks)
    return flat(merged.select("url_hash", "title", "tags", "summary", "indexed_at"))


@register
def stream_results_early(spark, sf):
    """All results arrive with half of the tasks; the other half of the tasks
    comes after a restart."""
    tasks = _tasks(spark, sf)
    cdir = X.stage_files(B.classification_results(spark, sf, tasks), "x3-class", STREAM_FILES)
    sdir = X.stage_files(B.summary_results(spark, sf, tasks), "x3-summary", STREAM_FILES)
    known = F.pmod(F.xxhash64("url_hash"), F.lit(2)) == 0
    tdir = X.stage_files(tasks.where(known), "x3-tasks", STREAM_FILES)
    places = {"out": scratch_path(spark, "x3-out"), "checkpoint": scratch_path(spark, "x3-ckpt")}
    X.stream_results_and_tasks(spark, B.article_stubs(spark, sf), cdir, sdir, tdir, **places)
    tasks.where(~known).repartition(STREAM_FILES).write.mode("append").parquet(tdir)
    merged, _ = X.stream_results_and_tasks(spark, B.article_stubs(spark, sf), cdir, sdir, tdir, **places)
    return flat(merged.select("url_hash", "title", "tags", "summary", "indexed_at"))


@register
def stream_url_dedup(spark, sf):
    pages = read_table(spark, sf, "pages")
    src = X.stage_files(pages, "x4-in", STREAM_FILES)
    return X.stream_url_dedup(spark, src, pages.schema)


@register
def stream_url_seen(spark, sf):
    """The same answer with the hashes in a bucketed table."""
    pages = read_table(spark, sf, "pages")
    src = X.stage_files(pages, "x4s-in", STREAM_FILES)
    return X.stream_url_seen(spark, src, pages.schema)
