"""URL filters and record splits.

All predicates are native expressions placed before any shuffle, so they
run inside the scan's codegen stage.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

# The publishers whose pages the content store keeps.
PUBLISHERS = [
    "cnn.com", "usatoday.com", "reuters.com", "foxnews.com", "cbssports.com", "espn.com",
    "androidpolice.com", "nydailynews.com", "politico.com", "theguardian.com",
    "news.yahoo.com", "digitaltrends.com", "gizmodo.com", "techradar.com", "9to5mac.com",
    "macworld.com", "people.com", "nfl.com", "247sports.com", "space.com", "vice.com",
    "ndtv.com", "msn.com", "indiatoday.in", "politifact.com",
]


def domain_filter(df: DataFrame, url_col: str, domains: Iterable[str]) -> DataFrame:
    """P1 as a filter."""
    return df.where(U.is_from_any_domain(url_col, domains))


def path_filter(df: DataFrame, url_col: str, prefixes: Iterable[str]) -> DataFrame:
    """P2 as a filter."""
    return df.where(U.has_any_path(url_col, prefixes))


def extension_filter(df: DataFrame, url_col: str, extensions: Iterable[str]) -> DataFrame:
    """P3 as a filter."""
    return df.where(U.has_any_extension(url_col, extensions))


def allowlist_semi(df: DataFrame, url_col: str, domains) -> DataFrame:
    """Keep rows whose URL host is a domain of the list or a subdomain
    of one. The host is exploded into its dot-suffixes, which turns the
    suffix test into an equi semi join. A Python list is a literal of known
    size and is broadcast; a DataFrame list is left to AQE, which measures
    it before choosing a broadcast."""
    if isinstance(domains, DataFrame):
        dom = minimal_domains(domains.select(F.lower("domain").alias("domain")))
        dom = dom.select(F.col("domain").alias("_suffix"))
    else:
        ds = sorted({d.lower() for d in domains})
        ds = [d for d in ds if not any(d.endswith("." + e) for e in ds)]
        spark = df.sparkSession
        dom = F.broadcast(spark.createDataFrame([(d,) for d in ds], "_suffix string"))
    host = U.authority(url_col)
    keyed = df.withColumn("_row_host", host).where(F.col("_row_host") != "")
    sfx = keyed.select("*", F.explode(U.host_suffixes("_row_host")).alias("_suffix"))
    # With no listed domain a dot-suffix of another, a host matches at most
    # one suffix, so each input row comes out at most once.
    return sfx.join(dom, "_suffix", "left_semi").drop("_suffix", "_row_host")


def minimal_domains(domains: DataFrame) -> DataFrame:
    """Drop listed domains covered by a shorter listed one (x.a.com by a.com)."""
    d = domains.select("domain").distinct()
    proper = d.select("domain", F.explode(F.filter(U.host_suffixes("domain"), lambda s: s != F.col("domain"))).alias("_sfx"))
    covered = proper.join(d.select(F.col("domain").alias("_sfx")), "_sfx", "left_semi").select("domain")
    return d.join(covered, "domain", "left_anti")


def quarantine_split(crawl: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) crawl records; errors keep message and
    trace, good records keep their HTTP status whatever it is."""
    bad = crawl.where(F.col("err").isNotNull())
    good = crawl.where(F.col("err").isNull())
    return good, bad
