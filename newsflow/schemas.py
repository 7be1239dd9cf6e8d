"""Declared schemas of the domain tables (no inference anywhere)."""

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampNTZType()
STRS = T.ArrayType(S)


def _s(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SEEDS = _s(("tag", S), ("url", S), ("seed_pos", I))
DOMAINS = _s(("domain", S))
PATHS = _s(("prefix", S))

CRAWL_STATUS = _s(("code", I), ("text", S))
PAGE_CONTENT = _s(("title", S), ("html_content", S))
CRAWL_ERR = _s(("err", S), ("trace", S))
CRAWL_OUTPUT = _s(("status", CRAWL_STATUS), ("content", PAGE_CONTENT), ("new_urls", STRS),
                  ("url", S), ("real_url", S), ("err", CRAWL_ERR))

RAW_PAGES = _s(("url_hash", S), ("url", S), ("html", S))

ARTICLES = _s(("url_hash", S), ("url", S), ("title", S), ("source", S), ("published_date", S),
              ("keywords", STRS), ("tags", STRS), ("summary", S), ("indexed_at", TS))

INFERENCE_TASKS = _s(("output_location", S), ("url_hash", S), ("task", S))
PAYLOAD = _s(("url_hash", S), ("body", S))

CLASS_ELEM = _s(("label", S), ("score", D))
SUMMARY_ELEM = _s(("summary_text", S))
CLASSIFICATION_RESULT = T.ArrayType(CLASS_ELEM)
SUMMARY_RESULT = T.ArrayType(SUMMARY_ELEM)
RAW_RESULTS = _s(("output_location", S), ("body", S), ("arrived_at", TS))

RAW_HISTORY = _s(("event_id", L), ("ts", TS), ("user_id", S), ("body", S))
HISTORY_BODY = _s(("key", S), ("event", S))
HISTORY_EVENTS = _s(("event_id", L), ("ts", TS), ("user_id", S), ("url_hash", S), ("event", S))

USER_ARTICLE_PREF = _s(("user_id", S), ("url_hash", S), ("liked", B))
USER_TAG_COUNTS = _s(("user_id", S), ("tag", S), ("ct", L))
GLOBAL_TOTAL = _s(("totalsum", L))
TAG_CATALOG = _s(("tag", S))

EDGES = _s(("src_url", S), ("dst_url", S))
SEEN = _s(("url_hash", S))
