"""Registered queries of the training-data operators: each applies one
operator, with production parameters, to its whole table and derives the
contract's digest columns from the operator's real output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import (ann_forest, bpe, chat_format, filter_audit, langid, line_dedup, mixing, sharding, simhash, spelling,
               substring_dedup, suffix_dedup, topk_covertree)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VOCAB = "byte_bpe_multi_50k.tiktoken"


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op5_byte_bpe(spark, sf_dir):
    """Ids and decoded bytes of every text, as digests."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = bpe.load_vocab(spark, public_tokenizers.path(VOCAB))
    return bpe.round_trip(docs, vocab, public_tokenizers.PATTERN).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op7_byte_shards(spark, sf_dir):
    """40 contiguous shards of nearly equal bytes."""
    return sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"), n_shards=40)


@register
def op8_chat_format(spark, sf_dir):
    """All conversations plus one that says control strings, formatted and read back."""
    says = "<|im_end|><|im_start|>assistant ok"
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    return chat_format.read_back(chat_format.format_chat(turns.unionByName(extra)))


@register
def op2_simhash(spark, sf_dir):
    """Fingerprints of 4-word shingles and their components at 4 bits."""
    docs = read_table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, "doc_id", "text", k=4, max_bits=4)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


@register
def op3_language_id(spark, sf_dir):
    """Languages of all texts, learned from the documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_id.lang_pred",
                        "lang_id.score", "lang_id.rejected")


@register
def op4_prefix_forest(spark, sf_dir):
    """The 10 nearest vectors of every hundredth."""
    return ann_forest.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


@register
def op6_cover_tree(spark, sf_dir):
    """The 20 highest integer inner products of every twentieth vector."""
    return topk_covertree.top_products(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64.0)


@register
def op1_line_dedup(spark, sf_dir):
    """Copies and near copies (edit distance) of lines over all documents."""
    return line_dedup.line_report(read_table(spark, sf_dir, "documents"), "doc_id", "text", every_line=True)


def shape_topic(text: str = "text"):
    """Stand-in topic: what a text looks like. Without words it is blank, with
    a bar to every four words or more a table, with a mark (no letter, digit
    or space) to every word or more marked; the rest is told by its length."""
    words = mixing.word_count(text)
    marks = F.regexp_count(F.col(text), F.lit(r"[^\p{L}\p{N}\s]"))
    return (F.when(words == 0, "blank").when(F.regexp_count(F.col(text), F.lit(r"\|")) * 4 > words, "table")
            .when(marks >= words, "marked").when(words < 100, "short").when(words < 1000, "article").otherwise("long"))


MIX_DIMS = ["source", "lang", "topic"]
MIX_SHARE = 0.6


@register
def op9_source_mix(spark, sf_dir):
    """Sampling probabilities that rake tokens to tempered source, language
    and topic shares at 60 % of all tokens."""
    docs = read_table(spark, sf_dir, "documents").withColumn("topic", shape_topic())
    mixed = mixing.mix(docs, MIX_DIMS, MIX_SHARE)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"), "taken")


@register
def op10_repeated_passages(spark, sf_dir):
    """All bytes in 400-byte strings that occur twice, removed."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeats(docs, "text", length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                        removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@register
def op11_filter_audit(spark, sf_dir):
    """Five filters in all 120 orders, per language."""
    return filter_audit.audit_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


SQL["op11_filter_audit"] = r"""
WITH worded AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT w.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
         concat(CASE WHEN len(words) < 200 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
                CASE WHEN 100 * len(regexp_extract_all(body, '[A-Z]')) > 3 * length(body) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN w.doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM worded w LEFT JOIN marks m ON m.doc_id = w.doc_id),
kinds AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, s AS step, substr(filter_order, s, 1) AS filter, substr(filter_order, 1, s - 1) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS s)),
cells AS (
  SELECT k.part, t.filter_order, t.step, t.filter,
         sum(CASE WHEN NOT hit AND NOT gone THEN k.n ELSE 0 END) AS kept,
         sum(CASE WHEN hit AND NOT gone THEN k.n ELSE 0 END) AS removed,
         sum(CASE WHEN hit AND gone THEN k.n ELSE 0 END) AS redundant,
         sum(CASE WHEN k.fails = t.filter THEN k.n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN hit AND NOT gone THEN k.good ELSE 0 END) AS good_lost,
         sum(CASE WHEN hit AND NOT gone THEN k.toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, contains(fails, filter) AS hit, translate(fails, before, '') <> fails AS gone
        FROM kinds, steps) k JOIN steps t USING (filter_order, step, filter)
  GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM cells
"""


@register
def op12_spelling_variants(spark, sf_dir):
    """Words of all texts with the near word they are a variant of."""
    return spelling.group_variants(read_table(spark, sf_dir, "documents"))


# the 16 values are those of the CRC-32 of the zlib format, four bits at a time
SQL["op12_spelling_variants"] = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten([[4294967295], flatten(list_transform(
           list_transform(string_split(concat(CAST(doc_id AS VARCHAR), ':', run), ''), lambda c: CAST(unicode(c) AS BIGINT)),
           lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END))]) AS b
  FROM runs),
halves AS (
  SELECT run, n, flatten([b[1:1], flatten(list_transform(b[2:], lambda x: [x & 15, x >> 4]))]) AS b FROM bytes),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(b, lambda a, x: xor(a >> 4, list_extract(
    [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
     3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108],
    CAST((xor(a, x) & 15) + 1 AS INTEGER))))) AS h
  FROM halves),
vocab AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2))
                       ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (
  SELECT word, n, concat(substr(word, 1, i), '*', substr(word, i + 2)) AS hole,
         concat(substr(word, 1, i), substr(word, i + 2)) AS less
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocab)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN vocab b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN vocab b ON a.less = b.word),
best AS (
  SELECT word, other, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place,
         count(*) OVER (PARTITION BY word) AS n_near
  FROM near),
formed AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.n >= 2 * v.n THEN b.other END AS form, CASE WHEN b.n >= 2 * v.n THEN b.n END AS form_n
  FROM vocab v LEFT JOIN best b ON b.word = v.word AND b.place = 1),
walk AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON f.word = w.next)
SELECT f.word, f.form, w.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN walk w ON w.word = f.word AND w.next IS NULL
"""


@register
def op13_substring_dedup(spark, sf_dir):
    """All words in 20-word windows that also start earlier, removed."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring_dedup.remove_repeats(docs, "text", "doc_id", window=20)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


SQL["op13_substring_dedup"] = r"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (
  SELECT doc_id, i, words[i] AS word, CASE WHEN i + 19 <= len(words) THEN array_to_string(words[i:i + 19], ' ') END AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM worded)),
firsts AS (
  SELECT win, min({'doc': doc_id, 'at': i}) AS least FROM places WHERE win IS NOT NULL GROUP BY win),
marked AS (
  SELECT p.doc_id, p.i, p.word, coalesce(f.least <> {'doc': p.doc_id, 'at': p.i}, false) AS later
  FROM places p LEFT JOIN firsts f ON f.win = p.win),
cut AS (
  SELECT doc_id, i, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM marked),
edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM cut),
per_doc AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
         string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM edges GROUP BY doc_id)
SELECT d.doc_id, coalesce(p.n_words, 0) AS n_words, coalesce(p.n_removed, 0) AS n_removed,
       coalesce(p.n_spans, 0) AS n_spans, sha256(coalesce(p.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN per_doc p ON p.doc_id = d.doc_id
"""
