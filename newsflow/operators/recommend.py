"""Interest model and batch recommendation for all users.

interest (J6, J7, A4, W3, F15) -> top_tags (W1) -> tag search top-k
(M6, W2) -> per-user lists (J4, T3, U1) with the latest-k fallback (T1,
J10); plus trending (T1, P10), summary view (SRC3, J3, P11), unread
filter (J9) and the limited scan (SRC4).

Scale notes
-----------
* Per-user windows (A4/W3, W1) partition by ``user_id``; the interest
  window and the top-3 window share that partitioning, so W1 adds no
  shuffle, and W1 runs as a WindowGroupLimit.
* The per-tag top-k (W2) is cut before the join with the users' top tags,
  so a hot tag contributes k rows, not all of its articles.
* Only two broadcasts are explicit, both with a proven bound: the
  one-row global total (J7) and the latest-k list (J10, k rows). Every
  other join leaves the choice to AQE, which broadcasts a side only after
  measuring it at run time and otherwise shuffles (and splits skew).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .search import tag_match_top


def interest(counts: DataFrame, catalog: DataFrame | None, totals: DataFrame,
             prior: float = 0.2) -> DataFrame:
    """interest = (ct/total) * (total/totalsum) / prior per (user, tag);
    NULL when total or totalsum is 0 (the reference divides by zero). A
    stored tag catalogue restricts the counts (J6); counts made from the
    same events as the catalogue need none."""
    c = counts if catalog is None else counts.join(catalog, "tag", "left_semi")
    c = c.withColumn("total", F.sum("ct").over(Window.partitionBy("user_id")))
    c = c.crossJoin(F.broadcast(totals.select("totalsum")))
    ct, tot, tsum = (F.col(x).cast("double") for x in ("ct", "total", "totalsum"))
    val = (ct / tot) * (tot / tsum) / F.lit(prior)
    return c.select("user_id", "tag", "ct", F.col("total").cast("bigint").alias("total"),
                    F.when((F.col("total") != 0) & (F.col("totalsum") != 0), val).alias("interest"))


def top_tags(interests: DataFrame, n: int = 3, min_interest: float | None = None) -> DataFrame:
    """The ``n`` best tags per user, interest desc then tag asc."""
    x = interests.where(F.col("interest").isNotNull())
    if min_interest is not None:
        x = x.where(F.col("interest") >= min_interest)
    w = Window.partitionBy("user_id").orderBy(F.desc("interest"), F.asc("tag"))
    return (x.withColumn("tag_rank", F.row_number().over(w)).where(F.col("tag_rank") <= n)
            .select("user_id", "tag", "interest", F.col("tag_rank").cast("int").alias("tag_rank")))


def latest(articles: DataFrame, k: int = 20, require_tags: bool = False) -> DataFrame:
    """Newest ``k`` articles (indexed_at desc, url_hash asc) as
    (pos, key, title, tags); tags default to [] (V4)."""
    a = articles.where(F.col("indexed_at").isNotNull())
    if require_tags:
        a = a.where(F.col("tags").isNotNull())
    top = a.orderBy(F.desc("indexed_at"), F.asc("url_hash")).limit(k)
    w = Window.orderBy(F.desc("indexed_at"), F.asc("url_hash"))  # k rows only
    return top.select(
        F.row_number().over(w).cast("int").alias("pos"),
        F.col("url_hash").alias("key"), "title",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def recommend(tops: DataFrame, articles: DataFrame, all_users: DataFrame,
              per_tag: int = 30, fallback: int = 20, dedupe: bool = False) -> DataFrame:
    """For each user the hits of each top tag in tag order
    (tag_rank, pos), duplicates kept; users without top tags get the
    latest ``fallback`` articles with tag_rank 0."""
    # both are read twice; as tables, the join on a popular tag can be split
    tops = materialize(tops, "top-tags")
    wanted = tops.select("tag").distinct()
    hits = materialize(tag_match_top(articles, wanted, k=per_tag), "tag-hits")
    rec = tops.join(hits, "tag").select(
        "user_id", "tag_rank", "pos", "tag", F.col("url_hash").alias("key"), "title",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    if dedupe:
        w = Window.partitionBy("user_id", "key").orderBy("tag_rank", "pos")
        rec = rec.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    cold = all_users.join(tops.select("user_id").distinct(), "user_id", "left_anti")
    fb = (cold.crossJoin(F.broadcast(latest(articles, fallback)))
          .select("user_id", F.lit(0).alias("tag_rank"), "pos",
                  F.lit(None).cast("string").alias("tag"), "key", "title", "tags"))
    return rec.unionByName(fb)


def remove_read(recs: DataFrame, read_pairs: DataFrame) -> DataFrame:
    """Drop recommendations the user has already read."""
    r = read_pairs.select("user_id", F.col("url_hash").alias("key"))
    return recs.join(r, ["user_id", "key"], "left_anti")


def summary_view(requests: DataFrame, articles: DataFrame, liked: DataFrame) -> DataFrame:
    """SRC3/J3/P11: (user_id, key) requests -> title, key, text, source, tags,
    liked (default false). Missing articles give no row; missing summary or
    tags give NULL text and [] tags (V15)."""
    a = articles.select(F.col("url_hash").alias("key"), "title", F.col("summary").alias("text"),
                        F.col("url").alias("source"),
                        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    lk = liked.select("user_id", F.col("url_hash").alias("key"), "liked")
    return (requests.join(a, "key").join(lk, ["user_id", "key"], "left")
            .select("user_id", "title", "key", "text", "source", "tags",
                    F.coalesce("liked", F.lit(False)).alias("liked")))


def scan_limit(articles: DataFrame, n: int = 10) -> DataFrame:
    """SRC4: a limited scan, made deterministic by ordering on the key."""
    return articles.orderBy("url_hash").limit(n).select("url_hash", "title")
