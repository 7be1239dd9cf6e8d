"""The walk with redirects to its end, against a plain queue."""

import os

import pytest

import __spark_entry__ as E
from newsflow.operators import filters as Flt
from newsflow.operators import frontier as Fr
from newsflow.sources import bindings as B

from test_articles_graph_text import brute_bfs

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_nothing_is_left_out_beyond_three_levels(spark):
    got = sorted((r.url, r.tag, r.seed_pos, r.depth) for r in E.queries()["frontier_redirects_whole"](spark, SF).collect())
    good, _ = Flt.quarantine_split(B.crawl_output(spark, SF))
    seeds = [(r.tag, r.url, r.seed_pos) for r in B.seeds(spark, SF).collect()]
    edges, aliases = (list(map(tuple, df.collect())) for df in (B.edges(spark, SF), Fr.redirects(good)))
    assert got == brute_bfs(seeds, edges, set(), None, aliases)
    assert max(r[3] for r in got) > 3


def test_a_long_light_walk_has_few_buckets(spark, monkeypatch):
    """A chain of 30 levels over tables that are written anew on the way."""
    made, init = [], Fr._Bucketed.__init__
    monkeypatch.setattr(Fr._Bucketed, "__init__", lambda self, s, name, key, buckets, *a: (made.append((name, buckets)), init(self, s, name, key, buckets, *a))[0])
    monkeypatch.setattr(Fr, "COMPACT_EVERY", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        seeds = spark.createDataFrame([("t", "u0", 0)], "tag string, url string, seed_pos int")
        edges = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(30)] + [("u30", "u3")], "src_url string, dst_url string")
        got = sorted((r.depth, r.url) for r in Fr.bfs_frontier(seeds, edges, max_visits=None, levels_per_job=4).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == [(i, f"u{i}") for i in range(31)]
    assert {n for _, n in made} == {Fr.LEAST} and [name for name, _ in made].count("bfs-visits") > 2


def test_buckets_grow_with_the_links():
    assert Fr.bucket_count(0, 200) == Fr.LEAST and Fr.bucket_count(0, 2) == 2
    assert Fr.bucket_count(5 * Fr.PER_BUCKET + 1, 200) == 6 and Fr.bucket_count(10**9, 200) == 200
