"""Page corpus jobs: canonical keys, outlinks, parsing, payloads, content
store, first-visit dedupe (SRC1, F1-F9, P5, P7, P8, A6, A7, U4, SNK1, SNK2, G4).

Everything is a narrow (per-row) native expression except the explicit
dedupe aggregates, which use ``min_by``/``max_by`` so partial aggregation
collapses a hot key map-side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from .filters import allowlist_semi


def canonicalize(df: DataFrame, url_col: str = "url") -> DataFrame:
    """add canonical_url and url_hash = md5(canonical_url)."""
    return (df.withColumn("canonical_url", U.canonical_url(url_col))
            .withColumn("url_hash", F.md5("canonical_url")))


def link_candidates(pages: DataFrame, base_col: str = "url", html_col: str = "html",
                    keep: Iterable[str] = ("page_id",)) -> DataFrame:
    """every anchor of every page, resolved against the page's base
    element or its URL, and canonical (P7: anchors without an href attribute
    never match)."""
    keep = list(keep)
    # the base is a column of its own: the links' expression reads it per link
    bases = H.base_href(html_col)
    pages = pages.select(*keep, F.col(html_col).alias("_html"), F.col(base_col).alias("_url"),
                         F.when(F.contains(F.lower(html_col), F.lit("<base")), bases).alias("_href"))
    pages = pages.select(*keep, "_html", F.when(F.col("_href").isNull(), F.col("_url"))
                         .otherwise(U.document_base("_url", "_href")).alias("_base"))
    base = F.col("_base")
    # Each step is its own array transform, so every intermediate is
    # computed once per link; exploding last keeps later filters on the
    # link above the generator instead of re-inlining the whole expression.
    links = F.transform(H.hrefs("_html"), lambda h: U.resolve_link(base, h))
    links = F.transform(links, lambda j: U.fix_dot_segments(j))
    links = F.transform(links, lambda a: U.strip_query(a))
    links = F.transform(links, lambda s: U.canonical_from_stripped(s))
    return pages.select(*keep, F.posexplode(links).alias("link_pos", "link"))


def outlinks(pages: DataFrame, domains: Iterable[str], prefixes: Iterable[str],
             base_col: str = "url", html_col: str = "html",
             keep: Iterable[str] = ("page_id",)) -> DataFrame:
    """Distinct absolute links per page that pass the domain and
    path filters."""
    keep = list(keep)
    c = link_candidates(pages, base_col, html_col, keep)
    c = c.where(U.is_from_any_domain("link", domains) & U.has_any_path("link", prefixes))
    return c.select(*keep, "link").distinct()


def outlink_counts(links: DataFrame, key: str = "page_id") -> DataFrame:
    """Number of distinct new links per page."""
    return links.groupBy(key).agg(F.count_distinct("link").alias("n_links"))


def parse_pages(raw: DataFrame, html_col: str = "html", sep: str = "",
                source: str = "unknown", published_date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC1/F5-F9/P6: (parsed, quarantined). Parsed rows carry title, the
    cleaned paragraph text, source and published_date; a page without a
    <title> goes to quarantine with its error."""
    ok = H.has_title(html_col)
    parsed = (raw.where(ok)
              .withColumn("title", H.title(html_col))
              .withColumn("text", H.clean_text(H.paragraph_text(html_col, sep)))
              .withColumn("source", F.lit(source))
              .withColumn("published_date", F.lit(published_date).cast("string"))
              .drop(html_col))
    bad = raw.where(~ok).select(*[c for c in raw.columns if c != html_col],
                                F.lit("title not found").alias("err"),
                                F.concat(F.lit("parse_pages: no <title> element in "), F.length(html_col),
                                         F.lit(" characters")).alias("trace"))
    return parsed, bad


def payload(parsed: DataFrame, text_col: str = "text", max_chars: int = 2200) -> DataFrame:
    """SNK2/F8/F16: JSON {"inputs": first max_chars code points}."""
    body = F.to_json(F.struct(F.substring(text_col, 1, max_chars).alias("inputs")))
    return parsed.select("url_hash", body.alias("body"))


def content_store(good: DataFrame, seeds: DataFrame, allow: Iterable[str] | DataFrame,
                  order_col: str = "page_id") -> DataFrame:
    """SNK1/P4/P5/G4: content keyed by md5 of the canonical *final* URL,
    seed pages skipped, only allow-listed hosts, the latest write per key
    kept (order_col = crawl order)."""
    x = good.withColumn("_req", U.canonical_url("url"))
    x = x.join(seeds.select(U.canonical_url("url").alias("_req")), "_req", "left_anti")
    x = x.withColumn("url", U.canonical_url(F.coalesce("real_url", "url")))
    x = allowlist_semi(x, "url", allow)
    x = x.withColumn("url_hash", F.md5("url"))
    # the newest write per key is picked on (key, order) alone; the body joins it
    body = F.col("content.html_content")
    x = x.select("url_hash", "url", body.alias("html"), F.struct(F.col(order_col), F.xxhash64(body)).alias("_ord"))
    newest = x.groupBy("url_hash").agg(F.max("_ord").alias("_ord"))
    return x.join(newest, ["url_hash", "_ord"]).dropDuplicates(["url_hash"]).select("url_hash", "url", "html")


def first_visits(requests: DataFrame, url_col: str, order_cols: list[str]) -> DataFrame:
    """Each URL hash once, the first request by ``order_cols`` wins."""
    x = requests.withColumn("url_hash", F.md5(F.col(url_col)))
    first = F.min_by(F.struct(*[F.col(c) for c in order_cols + [url_col]]),
                     F.struct(*[F.col(c) for c in order_cols]))
    out = x.groupBy("url_hash").agg(first.alias("_v"))
    return out.select("url_hash", *[F.col(f"_v.{c}").alias(c) for c in order_cols + [url_col]])
