"""Reader events -> per-user tag counters (E2: SRC5, P9, A1-A3, A5, A8).

Scale notes
-----------
* Events are pre-aggregated per (user, article) before the join with the
  article tags, so a hot article or a chatty user is reduced map-side
  (partial HashAggregate) before anything is shuffled.
* The tag join is an equi join on ``url_hash``; AQE turns it into a
  broadcast join when the tag side is small at run time and splits
  skewed partitions otherwise. Tags are exploded only after the join and
  only for the per-tag branch; the global total (A2) counts events, not
  tags, so it is computed before exploding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas


def parse_history(raw: DataFrame, body_col: str = "body") -> DataFrame:
    """SRC5/F16: (event_id, ts, user_id, body JSON) -> history_events."""
    b = F.from_json(F.col(body_col), schemas.HISTORY_BODY)
    return raw.select("event_id", "ts", "user_id", b["key"].alias("url_hash"),
                      b["event"].alias("event"))


def dispatch(events: DataFrame) -> DataFrame:
    """Like +1 / liked true; dislike -1 / liked false; read, readmore +1;
    any other event is dropped."""
    e = F.col("event")
    delta = (F.when(e == "like", F.lit(1)).when(e == "dislike", F.lit(-1))
             .when(e.isin("read", "readmore"), F.lit(1))).cast("bigint")
    liked = F.when(e == "like", F.lit(True)).when(e == "dislike", F.lit(False))
    return (events.withColumn("delta", delta).withColumn("liked", liked)
            .where(F.col("delta").isNotNull()))


def _article_tags(articles: DataFrame) -> DataFrame:
    # an article without a tags attribute fails the counter step
    return articles.where(F.col("tags").isNotNull()).select("url_hash", "tags")


def _per_article(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "url_hash").agg(F.sum("delta").alias("delta"))


def user_tag_counts(events: DataFrame, articles: DataFrame) -> DataFrame:
    """Signed counter per (user, tag), +-1 for each tag of the article."""
    tagged = _per_article(events).join(_article_tags(articles), "url_hash")
    return (tagged.select("user_id", F.explode("tags").alias("tag"), "delta")
            .groupBy("user_id", "tag").agg(F.sum("delta").cast("bigint").alias("ct")))


def global_total(events: DataFrame, articles: DataFrame) -> DataFrame:
    """A2: one row, totalsum = signed count of events on articles with tags."""
    per_url = events.groupBy("url_hash").agg(F.sum("delta").alias("delta"))
    kept = per_url.join(_article_tags(articles).select("url_hash"), "url_hash", "left_semi")
    return kept.agg(F.coalesce(F.sum("delta"), F.lit(0)).cast("bigint").alias("totalsum"))


def tag_catalog(events: DataFrame, articles: DataFrame) -> DataFrame:
    """Every tag ever acted on (dislikes included)."""
    touched = events.select("url_hash").distinct()
    return (_article_tags(articles).join(touched, "url_hash", "left_semi")
            .select(F.explode("tags").alias("tag")).distinct())


def liked_state(events: DataFrame) -> DataFrame:
    """A5: last like/dislike per (user, article) by (ts, event_id); stored
    even if the article has no tags."""
    return (events.where(F.col("liked").isNotNull())
            .groupBy("user_id", "url_hash")
            .agg(F.max_by("liked", F.struct("ts", "event_id")).alias("liked")))


def apply_counter_deltas(stored: DataFrame, deltas: DataFrame,
                         keys=("user_id", "tag"), col: str = "ct") -> DataFrame:
    """Stored counters plus new deltas; a missing counter counts as 0."""
    k = list(keys)
    s = stored.select(*k, F.col(col).alias("_old"))
    d = deltas.groupBy(*k).agg(F.sum(col).alias("_new"))
    return (s.join(d, k, "full_outer")
            .select(*k, (F.coalesce("_old", F.lit(0)) + F.coalesce("_new", F.lit(0)))
                    .cast("bigint").alias(col)))


def read_articles(events: DataFrame) -> DataFrame:
    """(user, article) pairs that were read (J9 input)."""
    return (events.where(F.col("event").isin("read", "readmore"))
            .select("user_id", "url_hash").distinct())


def users(events: DataFrame) -> DataFrame:
    return events.select("user_id").distinct()


__all__ = ["parse_history", "dispatch", "user_tag_counts", "global_total", "tag_catalog",
           "liked_state", "apply_counter_deltas", "read_articles", "users"]
