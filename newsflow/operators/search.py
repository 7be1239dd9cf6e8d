"""Tag relevance search (M6) as DataFrame aggregates, plus the top-k cut.

Each query tag is analysed like the article ``tags`` field (lower-cased
word tokens); articles are scored with BM25 (k1, b) from global
statistics N, df, dl, avgdl, and the best ``k`` per query tag are kept.

Plan shape: the query-token table (one row per distinct tag token) is the
small side of the postings join; the per-tag top-k runs as a
WindowGroupLimit, so a tag matching millions of articles ships only ``k``
rows per partition into the final window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import materialize


def _field_tokens(articles: DataFrame) -> DataFrame:
    toks = F.flatten(F.transform(F.col("tags"), lambda t: tokens(t)))
    return (articles.where(F.col("tags").isNotNull())
            .select("url_hash", toks.alias("toks"))
            .where(F.size("toks") > 0))


def bm25_scores(articles: DataFrame, query_tags: DataFrame, k1: float = 1.2, b: float = 0.75,
                digits: int = 9) -> DataFrame:
    """(tag, url_hash, score) for every article matching a query tag."""
    docs = _field_tokens(articles)
    stats = docs.agg(F.count("*").cast("double").alias("n_docs"),
                     (F.sum(F.size("toks")) / F.count("*")).alias("avgdl"))
    qtok = (query_tags.select("tag", F.explode(F.array_distinct(tokens("tag"))).alias("token"))
            .distinct())
    wanted = qtok.select("token").distinct()
    # written once for two uses; as a table, its join on a frequent token can be split
    postings = materialize(docs.select("url_hash", F.size("toks").alias("dl"), F.explode("toks").alias("token"))
                           .join(wanted, "token", "left_semi")
                           .groupBy("url_hash", "token", "dl").agg(F.count("*").alias("f")), "postings")
    df_tok = postings.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("f") / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    part = (postings.join(df_tok, "token").crossJoin(F.broadcast(stats))
            .select("url_hash", "token", (idf * tf).alias("w")))
    return (qtok.join(part, "token")
            .groupBy("tag", "url_hash").agg(F.round(F.sum("w"), digits).alias("score")))


def tag_match_top(articles: DataFrame, query_tags: DataFrame, k: int = 30, **kw) -> DataFrame:
    """Best ``k`` articles per tag by score desc, indexed_at desc,
    url_hash asc; ``pos`` is the 1-based rank."""
    scored = bm25_scores(articles, query_tags, **kw)
    ranked = scored.join(articles.select("url_hash", "indexed_at"), "url_hash")
    w = Window.partitionBy("tag").orderBy(F.desc("score"), F.desc_nulls_last("indexed_at"),
                                          F.asc("url_hash"))
    best = (ranked.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
            .withColumn("pos", F.col("pos").cast("int")))
    # titles and tags meet only the k rows per tag
    return best.join(articles.select("url_hash", "title", "tags"), "url_hash")
