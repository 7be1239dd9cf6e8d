"""Keyed tables and the seen set against tables written whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsflow.operators import keyed_table as Kt
from newsflow.operators.articles import upsert_merge
from newsflow.session import materialize, scratch_path

SCHEMA = "k string, a int, b string"


def table(spark, buckets=16, schema=SCHEMA):
    return Kt.KeyedTable(spark, scratch_path(spark, "t-keyed"), "k", schema, buckets)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_small_patch_rewrites_its_buckets_only(spark):
    t = table(spark)
    assert t.read().collect() == [] and t.versions() == []
    base = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").cast("int").alias("a"), F.lit("x").alias("b"))
    assert Kt.merge_into(t, 0, base) == list(range(16))
    patch = spark.createDataFrame([("k3", 7, None), ("k500", None, "y"), ("new", 1, "z"), ("k3", None, "w")], SCHEMA)
    touched = t.touched(patch)
    before = t.manifest()
    assert Kt.merge_into(t, 1, patch) == touched and 1 <= len(touched) <= 3
    after = t.manifest()
    assert {b for b in after if after[b] != before[b]} == set(touched)
    assert rows(t.read()) == rows(upsert_merge(base, patch, "k").select("k", "a", "b"))
    assert rows(t.read(version=0)) == rows(base)                                  # the old version is still there
    # a replay, also with other rows, changes nothing
    assert Kt.merge_into(t, 1, base) == [] and t.manifest() == after
    with pytest.raises(ValueError):
        t.put(0 - 1, base, lambda x, y: y)
    # only the folders of the buckets asked for are read
    assert {f.split("/data/")[1].split("/part")[0] for f in t.read(buckets=touched).inputFiles()} == {
        f[5:] for b in touched for f in after[b]}


def test_replace_order_and_vacuum(spark):
    t = Kt.KeyedTable(spark, scratch_path(spark, "t-keyed"), "k", "k string, v int, at int", 4)
    frame = lambda x: spark.createDataFrame(x, "k string, v int, at int")
    Kt.replace_into(t, 0, frame([("a", 1, 5), ("b", 2, 5), ("c", 3, 5)]), "at")
    Kt.replace_into(t, 3, frame([("a", 9, 4), ("b", 8, 6)]), "at")
    assert rows(t.read()) == [("a", 1, 5), ("b", 8, 6), ("c", 3, 5)]
    named = {f for v in t.versions() for fs in t.manifest(v).values() for f in fs}
    gone = t.vacuum(keep=1)
    assert gone and set(gone) == named - {f for fs in t.manifest().values() for f in fs}
    assert t.versions() == [3] and rows(t.read()) == [("a", 1, 5), ("b", 8, 6), ("c", 3, 5)]
    assert t.vacuum(keep=1) == []


def test_a_write_that_failed_leaves_no_trace(spark):
    t = table(spark, 4)
    Kt.merge_into(t, 0, spark.createDataFrame([("a", 1, "x")], SCHEMA))
    publish, t._publish = t._publish, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        Kt.merge_into(t, 1, spark.createDataFrame([("a", 2, "y"), ("b", 3, "y")], SCHEMA))
    t._publish = publish
    assert rows(t.read()) == [("a", 1, "x")]
    Kt.merge_into(t, 1, spark.createDataFrame([("c", 3, "z")], SCHEMA))
    assert rows(t.read()) == [("a", 1, "x"), ("c", 3, "z")]


def test_appends_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(Kt, "FOLDERS", 2)
    t = table(spark, 1)
    for v in range(5):
        t.append(v, spark.createDataFrame([(f"k{v}", v, "x")], SCHEMA))
    assert [len(t.manifest(v)[0]) for v in range(5)] == [1, 2, 1, 2, 1]
    assert rows(t.read()) == [(f"k{v}", v, "x") for v in range(5)]
    t.append(9, spark.createDataFrame([], SCHEMA))
    assert len(rows(t.read())) == 5 and t.versions()[-1] == 9


def test_key_names_and_bucket_column(spark):
    t = Kt.KeyedTable(spark, scratch_path(spark, "t-keyed"), "_bucket", "_bucket string, __bucket int", 4)
    Kt.merge_into(t, 0, spark.createDataFrame([("a", 1), (None, 2)], "_bucket string, __bucket int"))
    assert sorted(tuple(map(str, r)) for r in t.read().collect()) == [("None", "2"), ("a", "1")]


def test_filters_never_miss(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-2**63, 2**63 - 1, 3000)
    f = Kt._filled(h, np.zeros(Kt._bits_for(len(h)) // 8, np.uint8))
    assert Kt._may_hold(f, h).all()
    other = rng.integers(-2**63, 2**63 - 1, 20_000)
    assert Kt._may_hold(f, other).mean() < 0.02
    both = Kt._filled(h[:1000], np.zeros(8192, np.uint8)) | Kt._filled(h[1000:], np.zeros(8192, np.uint8))
    assert (both == Kt._filled(h, np.zeros(8192, np.uint8))).all()               # merged by or


def test_runs_equal_their_union(spark):
    rng = random.Random(4)
    runs = [[f"u{rng.randint(0, 400)}" for _ in range(rng.choice([0, 3, 150]))] for _ in range(6)] + [["u1", None, "u1"]]
    s = Kt.SeenSet(spark, scratch_path(spark, "t-seen"), "url", 8)
    seen = set()
    for v, run in enumerate(runs):
        df = spark.createDataFrame([(u,) for u in run], "url string")
        want = {u for u in run if u is not None} - seen
        new = s.add(v, df)
        assert sorted(r.url for r in new.collect()) == sorted(want)
        manifest = s.keys.manifest()
        assert sorted(r.url for r in s.add(v, df).collect()) == sorted(want) and s.keys.manifest() == manifest   # a replay
        seen |= want
        assert sorted(r.url for r in s.read().collect()) == sorted(seen)


def test_a_run_reads_only_the_buckets_its_candidates_hit(spark, monkeypatch):
    s = Kt.SeenSet(spark, scratch_path(spark, "t-seen"), buckets=32)
    first = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("url_hash"))
    s.add(0, first)
    read, asked = s.keys.read, []
    monkeypatch.setattr(s.keys, "read", lambda version=None, buckets=None: asked.append(buckets) or read(version, buckets))
    probe = materialize(first.limit(2).unionByName(spark.createDataFrame([("fresh",)], "url_hash string")), "t-probe")
    assert [r.url_hash for r in s.add(1, probe).collect()] == ["fresh"]
    hit = set(s.keys.touched(probe))
    assert asked and set(asked[0]) <= hit and len(asked[0]) <= 3                   # of 32
    files = read(0, asked[0]).inputFiles()
    assert len(files) == len(asked[0])
    # unseen candidates alone read next to nothing
    asked.clear()
    s.add(2, spark.range(40).select(F.md5(F.concat(F.lit("n"), "id")).alias("url_hash")))
    assert len(asked[0]) <= 8


def test_full_filters_are_made_anew(spark):
    s = Kt.SeenSet(spark, scratch_path(spark, "t-seen"), buckets=2)
    size = lambda: {r.bucket: (r.n, len(r.bits)) for r in s.filters.read().collect()}
    make = lambda lo, hi: spark.range(lo, hi).select(F.md5(F.col("id").cast("string")).alias("url_hash"))
    s.add(0, make(0, 20))
    small = size()
    for v in range(1, 5):
        assert s.add(v, make(0, 20 + 600 * v)).count() == 600
    assert sum(n for n, _ in size().values()) == 2420 and all(size()[b][1] > small[b][1] for b in small)
