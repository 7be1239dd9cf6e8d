"""Edge rows for counters, interest and recommendation (FIXTURES.md section 3)."""

import datetime as dt

from pyspark.sql import functions as F

from newsflow.operators import history as Hst
from newsflow.operators import recommend as Rec

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    """rows: (event_id, minute, user, url_hash, event)."""
    data = [(i, T0 + dt.timedelta(minutes=m), u, k, e) for i, m, u, k, e in rows]
    return spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id string, url_hash string, event string")


def articles(spark, rows):
    """rows: (url_hash, tags or None, minute)."""
    data = [(k, f"url-{k}", f"title-{k}", "src", None, None, t, None, T0 + dt.timedelta(minutes=m))
            for k, t, m in rows]
    from newsflow import schemas
    return spark.createDataFrame(data, schemas.ARTICLES)


def as_map(df, key_cols, val):
    return {tuple(r[c] for c in key_cols): r[val] for r in df.collect()}


def test_counters_and_totals(spark):
    art = articles(spark, [("a", ["x", "y"], 0), ("b", None, 1), ("c", [], 2), ("d", ["x"], 3)])
    ev = Hst.dispatch(events(spark, [
        (1, 0, "u1", "a", "like"), (2, 1, "u1", "a", "dislike"),      # like then dislike: nets 0
        (3, 2, "u2", "a", "like"), (4, 3, "u2", "a", "like"),         # like twice: +2
        (5, 4, "u3", "d", "read"), (6, 5, "u3", "d", "readmore"),
        (7, 6, "u3", "d", "signup"),                                  # unknown event: ignored
        (8, 7, "u4", "b", "like"),                                    # no tags: liked kept, nothing counted
        (9, 8, "u4", "c", "read"),                                    # [] tags: only the total counted
    ]))
    counts = as_map(Hst.user_tag_counts(ev, art), ["user_id", "tag"], "ct")
    assert counts == {("u1", "x"): 0, ("u1", "y"): 0, ("u2", "x"): 2, ("u2", "y"): 2, ("u3", "x"): 2}
    assert Hst.global_total(ev, art).first()["totalsum"] == 0 + 2 + 2 + 1
    assert sorted(r["tag"] for r in Hst.tag_catalog(ev, art).collect()) == ["x", "y"]
    liked = as_map(Hst.liked_state(ev), ["user_id", "url_hash"], "liked")
    assert liked == {("u1", "a"): False, ("u2", "a"): True, ("u4", "b"): True}


def test_liked_same_ts_uses_event_id(spark):
    ev = Hst.dispatch(events(spark, [(2, 0, "u", "a", "dislike"), (1, 0, "u", "a", "like")]))
    assert Hst.liked_state(ev).first()["liked"] is False


def test_counter_apply_missing_is_zero(spark):
    stored = spark.createDataFrame([("u", "x", 3)], "user_id string, tag string, ct long")
    deltas = spark.createDataFrame([("u", "x", -1), ("u", "y", 2), ("u", "y", 1)],
                                   "user_id string, tag string, ct long")
    got = as_map(Hst.apply_counter_deltas(stored, deltas), ["user_id", "tag"], "ct")
    assert got == {("u", "x"): 2, ("u", "y"): 3}


def test_interest_edges(spark):
    counts = spark.createDataFrame(
        [("z", "x", 1), ("z", "y", -1),          # total 0 -> NULL interest
         ("d", "x", -2),                         # only dislikes
         ("t", "a", 3), ("t", "b", 3), ("t", "c", 2), ("t", "e", 1)],   # ties, 4 tags
        "user_id string, tag string, ct long")
    cat = counts.select("tag").distinct()
    tot = spark.createDataFrame([(10,)], "totalsum long")
    it = Rec.interest(counts, cat, tot)
    vals = as_map(it, ["user_id", "tag"], "interest")
    assert vals[("z", "x")] is None and vals[("z", "y")] is None
    assert abs(vals[("d", "x")] - (1.0 * (-2 / 10) / 0.2)) < 1e-12
    # the interests of a user add up to total/totalsum/prior
    assert abs(sum(v for (u, _), v in vals.items() if u == "t") - (9 / 10) / 0.2) < 1e-12
    top = Rec.top_tags(it)
    got = sorted((r["user_id"], r["tag_rank"], r["tag"]) for r in top.collect())
    assert got == [("d", 1, "x"), ("t", 1, "a"), ("t", 2, "b"), ("t", 3, "c")]
    zero = Rec.interest(counts, cat, spark.createDataFrame([(0,)], "totalsum long"))
    assert all(r["interest"] is None for r in zero.collect())


def test_recommend_fallback_and_duplicates(spark):
    rows = [(f"k{i:02d}", ["Sci/Tech"], i) for i in range(31)] + [("both", ["sci", "sport"], 40),
                                                                    ("plain", ["sport"], 41)]
    art = articles(spark, rows)
    tops = spark.createDataFrame([("u1", "sci", 1.0, 1), ("u1", "sport", 0.5, 2), ("u1", "none", 0.1, 3)],
                                 "user_id string, tag string, interest double, tag_rank int")
    users = spark.createDataFrame([("u1",), ("cold",)], "user_id string")
    rec = Rec.recommend(tops, art, users).collect()
    mine = [r for r in rec if r["user_id"] == "u1"]
    assert len([r for r in mine if r["tag_rank"] == 1]) == 30          # tag with 31 articles -> 30
    assert not [r for r in mine if r["tag_rank"] == 3]                  # tag without articles
    assert [r["key"] for r in mine].count("both") == 2                 # under two top tags: twice
    cold = sorted((r["pos"], r["key"]) for r in rec if r["user_id"] == "cold")
    assert len(cold) == 20 and cold[0][1] == "plain"                   # latest first
    dedup = Rec.recommend(tops, art, users, dedupe=True).where("user_id = 'u1'").collect()
    assert [r["key"] for r in dedup].count("both") == 1


def test_trending_sizes_and_ties(spark):
    for n in (19, 20, 21):
        art = articles(spark, [(f"k{i:02d}", None if i == 0 else ["t"], i // 2) for i in range(n)])
        lat = Rec.latest(art, 20).orderBy("pos").collect()
        assert len(lat) == min(n, 20)
        keys = [r["key"] for r in lat]
        assert keys[0] in (f"k{n - 1:02d}", f"k{n - 2:02d}")
        assert all(r["tags"] is not None for r in lat)                # article without tags kept

    art = articles(spark, [("b", ["t"], 5), ("a", ["t"], 5)])
    assert [r["key"] for r in Rec.latest(art, 20).orderBy("pos").collect()] == ["a", "b"]


def test_summary_view_defaults(spark):
    art = articles(spark, [("a", None, 0)])
    req = spark.createDataFrame([("u", "a"), ("u", "missing")], "user_id string, key string")
    liked = spark.createDataFrame([], "user_id string, url_hash string, liked boolean")
    rows = Rec.summary_view(req, art, liked).collect()
    assert len(rows) == 1 and rows[0]["liked"] is False and rows[0]["tags"] == [] and rows[0]["text"] is None


def test_plan_shapes(spark):
    counts = spark.range(1000).select(F.concat(F.lit("u"), (F.col("id") % 50).cast("string")).alias("user_id"),
                                      F.concat(F.lit("t"), (F.col("id") % 17).cast("string")).alias("tag"),
                                      F.lit(1).cast("long").alias("ct"))
    it = Rec.interest(counts, counts.select("tag").distinct(), spark.createDataFrame([(1000,)], "totalsum long"))
    plan = Rec.top_tags(it)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "RankLimit" in plan
    assert "BroadcastNestedLoopJoin" in plan or "BroadcastExchange" in plan
