"""Text jobs standing in for the hosted models (M1-M4), as DataFrame
aggregates over exploded tokens.

* ``keywords_tfidf`` (M3): 1-2-gram TF-IDF after English stop words,
  best ``top_n`` per document.
* ``summarize`` (M2): extractive SumBasic scoring (mean document probability
  of a sentence's tokens, on request with its re-weighting after each
  choice), best ``k`` sentences per document given in document order.
* ``nb_train`` / ``nb_classify`` / ``nb_scores`` (M1): multinomial naive Bayes
  with Laplace smoothing; the best class, or the scores of all.
* ``keywords_mmr`` (M4): greedy maximal-marginal-relevance re-ranking of
  each document's candidates, a fold over an array of at most
  ``candidates`` elements.
* ``keywords_maxsum`` (M3/M4): the ``top_n`` candidates that are least alike
  in sum, exactly, by meeting in the middle (``operators.maxsum``).

Scale notes: a row is a document, so what is counted per document is counted
inside the row (run lengths of the sorted terms) and no text is shuffled, but
for tables of fewer partitions than cores (``spread``): shuffles carry (id,
term, count). The counts are written as a table where two
uses follow (document frequencies and the join back), so texts are tokenised
once and both sides of the joins on a term are plain shuffles of tables, which
adaptive execution can split when a term is in most documents. Sentences are
ranked where the document is. Every ``ln`` result is rounded before ranking so
ties break the same way everywhere.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_tokens, sentences, tokens
from ..session import materialize
from .grams import _slices, best_grams
from .maxsum import least_alike

SLICE = 1 << 19       # tokens that are counted at once


def spread(docs: DataFrame) -> DataFrame:
    """A table that comes in fewer partitions than there are cores (a few
    small files) is dealt anew; any larger one stays where it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _counted(row: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, row, count) of each that occurs, in the order of (code, row)."""
    rows = int(row[-1]) + 1 if len(row) else 1
    key, count = np.unique(code.astype(np.int64) * rows + row, return_counts=True)
    return key // rows, key % rows, count.astype(np.int64)


def count_terms(batch: pa.RecordBatch, pairs: bool) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, place in terms, row, count) of the token arrays in the second
    column, ordered by place; with ``pairs`` once more for adjacent tokens."""
    lists = batch.column(1)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    row, code = np.repeat(np.arange(batch.num_rows), size), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary
    yield words, *_counted(row, code, len(words))
    if pairs and len(code) > 1:
        same = row[1:] == row[:-1]
        both, code = np.unique((code[:-1] * len(words) + code[1:])[same], return_inverse=True)
        if len(both):
            first, second = (words.take(pa.array(x)) for x in (both // len(words), both % len(words)))
            yield pc.binary_join_element_wise(first, second, " "), *_counted(row[1:][same], code, len(both))


def term_counts(docs: DataFrame, id_col: str, toks: Column, out: str, count: str, pairs: bool = False) -> DataFrame:
    """(id, term, count) of the tokens (with ``pairs`` also of the pairs of
    adjacent ones) of each document (row): no shuffle."""
    kind = docs.select(id_col).schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1, SLICE):
                for terms, place, row, n in count_terms(part, pairs):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), terms.take(pa.array(place)), pa.array(n)],
                                                     names=[kind.name, out, count])

    schema = T.StructType([kind, T.StructField(out, T.StringType()), T.StructField(count, T.LongType())])
    return docs.select(id_col, toks.alias("_t")).mapInArrow(run, schema)


def term_blocks(docs: DataFrame, id_col: str, toks: Column, out: str) -> DataFrame:
    """(term, docs): the counts of ``term_counts`` as one row per term and
    slice of rows, docs an array of (id, n): a term that many documents hold
    is shuffled once for a slice of them."""
    kind = docs.select(id_col).schema[0]
    schema = T.StructType([T.StructField(out, T.StringType()), T.StructField("docs", T.ArrayType(T.StructType(
        [T.StructField("id", kind.dataType), T.StructField("n", T.LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1, SLICE):
                for terms, place, row, n in count_terms(part, False):
                    at, first = np.unique(place, return_index=True)
                    held = pa.StructArray.from_arrays([part.column(0).take(pa.array(row)), pa.array(n)], names=["id", "n"])
                    blocks = pa.ListArray.from_arrays(pa.array(np.append(first, len(place)), pa.int32()), held)
                    yield pa.RecordBatch.from_arrays([terms.take(pa.array(at)), blocks], names=[out, "docs"])

    return docs.select(id_col, toks.alias("_t")).mapInArrow(run, schema)


def keywords_tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   top_n: int = 10, stop_words=None, digits: int = 9) -> DataFrame:
    """M3: (id, rank, gram, tf, df, score); score = tf * ln((N+1)/(df+1))."""
    own = spread(docs.select(id_col, text_col)).select(id_col, content_tokens(text_col, stop_words).alias("_toks"))
    best, n = best_grams(own, top_n, digits)
    # ranked once more: rows of one id are one document here
    scored = best.withColumn("score", F.round(F.col("tf") * F.log((F.lit(float(n)) + 1) / (F.col("df") + 1)), digits))
    w = Window.partitionBy(id_col).orderBy(F.desc("score"), F.asc("gram"))
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
            .select(id_col, F.col("rank").cast("int").alias("rank"), "gram", "tf", "df", "score"))


def best_sentences(tokens_of: list[list[str]], k: int, digits: int, reweight: bool) -> list[tuple[int, float]]:
    """(place from 0, score) of the ``k`` best sentences in order. A score is
    the mean probability of the sentence's tokens; with ``reweight`` the
    probabilities of a chosen sentence's tokens are squared before the next
    choice (as in SumBasic), and a score is that of the round. Sentences
    without tokens are never chosen; ties go to the earlier one."""
    counts = Counter(t for toks in tokens_of for t in toks)
    n = sum(counts.values())
    weight = {t: c / n for t, c in counts.items()}
    left = {p: toks for p, toks in enumerate(tokens_of) if toks}
    score = lambda p: round_half_up(sum(weight[t] for t in left[p]) / len(left[p]), digits)
    if not reweight:
        return sorted(heapq.nsmallest(k, ((-score(p), p) for p in left)), key=lambda x: x[1])
    out = []
    while left and len(out) < k:
        best = min((-score(p), p) for p in left)
        out.append(best)
        for t in set(left.pop(best[1])):
            weight[t] **= 2
    return sorted(out, key=lambda x: x[1])


def round_half_up(x: float, digits: int) -> float:
    """As the engine rounds: half up on the decimal digits of the number."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def summarize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
              digits: int = 9, reweight: bool = False) -> DataFrame:
    """M2: (id, pos, sentence, score) for the ``k`` best sentences of each
    document, pos = 1-based sentence position, in document order; see
    ``best_sentences``. The sentences and their tokens are made by the engine,
    chosen in the row's own task and given out: nothing is shuffled."""
    kind = docs.select(id_col).schema[0]
    rows = spread(docs.select(id_col, text_col)).select(id_col, sentences(text_col).alias("_s")).select(id_col, "_s", F.transform("_s", tokens).alias("_t"))
    schema = T.StructType([kind, T.StructField("pos", T.IntegerType()), T.StructField("sentence", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2, SLICE // 16):
                row, at, score = (one_by_one if reweight else chosen_sentences)(part.column(2), k, digits)
                lists = part.column(1)
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                first = np.cumsum(size) - size
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array((at - first[row] + 1).astype(np.int32)),
                     lists.flatten().take(pa.array(at, pa.int64())), pa.array(score, pa.float64())],
                    names=[kind.name, "pos", "sentence", "score"])

    return rows.mapInArrow(run, schema)


def one_by_one(docs: pa.ListArray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """``chosen_sentences`` with re-weighting, a document after the other."""
    row, at, score, first = [], [], [], 0
    for i, toks in enumerate(docs.to_pylist()):
        for minus, p in best_sentences(toks or [], k, digits, True):
            row.append(i)
            at.append(first + p)
            score.append(-minus)
        first += len(toks or [])
    return np.array(row, np.int64), np.array(at, np.int64), score


def chosen_sentences(docs: pa.ListArray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place among all sentences, score) of the ``k`` best sentences of
    every row, as ``best_sentences`` chooses them, for all rows at once. Sums
    are of whole numbers; a score next to where rounding turns is rounded as
    there."""
    inner = docs.flatten()
    row = np.repeat(np.arange(len(docs)), pc.fill_null(pc.list_value_length(docs), 0).to_numpy(zero_copy_only=False))
    size = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = inner.flatten().dictionary_encode()
    owner = np.repeat(row, size)
    key = owner * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False)
    _, of, count = np.unique(key, return_inverse=True, return_counts=True)
    held = count[of]                                   # of each token: its count in its document
    upto = np.concatenate([[0], np.cumsum(held)])
    end = np.cumsum(size)
    n = np.bincount(owner, minlength=len(docs))
    at = np.flatnonzero(size)
    exact = (upto[end] - upto[end - size])[at] / (n[row[at]] * size[at]) * 10.0 ** digits
    score = np.floor(exact + 0.5) / 10.0 ** digits
    for i in np.flatnonzero(np.abs(exact - np.floor(exact) - 0.5) <= 10.0 ** (digits - 14)):
        s = at[i]
        weights = (held[end[s] - size[s]:end[s]] / n[row[s]]).tolist()
        score[i] = round_half_up(sum(weights) / len(weights), digits)
    order = np.lexsort((at, -score, row[at]))
    ranked = row[at][order]
    place = np.arange(len(order)) - np.searchsorted(ranked, ranked)
    best = np.sort(order[place < k])
    return row[at][best], at[best], score[best]


def nb_train(labelled: DataFrame, class_col: str, text_col: str = "text",
             alpha: float = 1.0) -> dict[str, DataFrame]:
    """M1 training. Returns the tables
    classes(classes: array of (class, log_prior, log_norm)), one row, and
    weights(token, weights: class -> w), one row per training token:
    log_norm = ln(class_tokens + alpha*V), w = ln(count + alpha) - ln(alpha)
    for the (token, class) pairs seen in training, so the model stores only
    observed pairs (an unseen pair contributes ln(alpha) per occurrence).
    Documents without a class count in the priors and the vocabulary and are
    a class of their own (NULL) that has no tokens."""
    docs = labelled.select(F.col(class_col).alias("class"), text_col)
    counts = materialize(docs.select("class", F.explode(tokens(text_col)).alias("token"))
                         .groupBy("token", "class").agg(F.count("*").alias("cnt")), "nb-counts")
    w = F.log(F.col("cnt") + alpha) - math.log(alpha)
    pair = F.when(F.col("class").isNotNull(), F.struct("class", w.alias("w")))      # a map has no NULL key
    weights = materialize(counts.groupBy("token").agg(F.map_from_entries(F.collect_list(pair)).alias("weights")), "nb-weights")
    v = weights.agg(F.count("*").cast("double").alias("v"))
    n_docs = docs.agg(F.count("*").alias("n_all"))
    class_tokens = counts.groupBy("class").agg(F.sum("cnt").alias("class_tokens"))
    classes = (docs.groupBy("class").agg(F.count("*").alias("n_c"))
               .join(class_tokens, "class", "left")
               .crossJoin(F.broadcast(n_docs)).crossJoin(F.broadcast(v))
               .select("class", F.log(F.col("n_c") / F.col("n_all")).alias("log_prior"),
                       F.log(F.coalesce("class_tokens", F.lit(0)) + alpha * F.col("v")).alias("log_norm")))
    classes = materialize(classes.agg(F.collect_list(F.struct("class", "log_prior", "log_norm")).alias("classes")), "nb-classes")
    return {"classes": classes, "weights": weights, "alpha": alpha}


def _nb_scored(docs: DataFrame, model: dict, id_col: str, text_col: str, digits: int) -> DataFrame:
    """(id, _scores): for each document the array of (minus, none, class) of
    all classes, minus the rounded score with its sign turned, none true for
    the NULL class, which is the last of equals. One join with the
    model gives both the known tokens and the class sums; the classes meet the
    documents as one array, not as rows."""
    log_alpha = math.log(model["alpha"])
    labels = [c["class"] for c in model["classes"].first()[0]]
    blocks = term_blocks(spread(docs.select(id_col, text_col)), id_col, tokens(text_col), "token")
    seen = F.array(*[F.coalesce(F.try_element_at("weights", F.lit(c)), F.lit(0.0)) for c in labels])
    hit = blocks.join(model["weights"], "token").select(F.explode("docs").alias("d"), seen.alias("w"))
    # one row a document and task: the sum of every class and the known tokens
    per_doc = hit.groupBy(F.col("d.id").alias(id_col)).agg(
        F.array(*[F.sum(F.col("d.n") * F.col("w")[i]) for i in range(len(labels))]).alias("_seen"),
        F.sum("d.n").cast("double").alias("_known"))
    every = docs.select(id_col).join(per_doc, id_col, "left").crossJoin(F.broadcast(model["classes"]))  # one row

    def score(c: Column, i: Column) -> Column:
        seen = F.coalesce(F.get("_seen", i), F.lit(0.0))
        known = F.coalesce("_known", F.lit(0.0))
        return F.struct((-F.round(c["log_prior"] + known * (F.lit(log_alpha) - c["log_norm"]) + seen, digits)).alias("minus"),
                        c["class"].isNull().alias("none"), c["class"].alias("class"))

    return every.select(id_col, F.array_sort(F.transform("classes", score)).alias("_scores"))


def nb_weighed(docs: DataFrame, model: dict, toks: Column, out: str, id_col: str = "doc_id") -> DataFrame:
    """(id, out) of every row: for each distinct token of the array ``toks``
    that the model knows its count and its weight for every class, in the order
    of ``model["classes"]``, one after the other in an array of doubles; NULL
    where no token is known. For scorers (``scoring.naive_bayes_scorer``) that
    need not hold the vocabulary. A known token is moved to its documents as a
    number, once for each, and collected where its document is: gathering sets
    before the shuffle would sort and keep every token twice."""
    labels = [c["class"] for c in model["classes"].first()[0]]
    rows = docs.select(id_col, toks.alias("_t"))
    # rows of one id are told apart by their tokens; equal rows get equal sets
    rows = rows.select(F.struct(F.col(id_col).alias("id"), F.unhex(F.md5(F.array_join("_t", " "))).alias("text")).alias("_k"), "_t")
    weights = F.array(*[F.coalesce(F.try_element_at("weights", F.lit(c)), F.lit(0.0)) for c in labels])
    # written, so that a token's number is the same however often it is read
    numbered = materialize(model["weights"].select("token", weights.alias("w"), F.monotonically_increasing_id().alias("code")), "nb-codes")
    hit = term_blocks(spread(rows), "_k", F.col("_t"), "token").join(numbered, "token").select(
        "code", F.explode("docs").alias("d"), "w").select(F.col("d.id").alias("_k"), "code", F.col("d.n").alias("n"), "w")
    known = hit.repartition("_k").groupBy("_k").agg(F.collect_set(F.struct("code", "n", "w")).alias("_w"))
    known = known.select("_k", F.flatten(F.transform("_w", lambda x: F.concat(F.array(x["n"].cast("double")), x["w"]))).alias(out))
    every = rows.select("_k")
    return every.join(known, every["_k"].eqNullSafe(known["_k"]), "left").select(every["_k"]["id"].alias(id_col), out)


def nb_classify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
                digits: int = 6) -> DataFrame:
    """M1 scoring: (id, pred, score), score = log_prior + sum over known
    tokens of f * ln((count + alpha) / norm), rounded; ties go to the
    smaller class. Tokens outside the training vocabulary are ignored."""
    best = F.try_element_at("_scores", F.lit(1))
    return _nb_scored(docs, model, id_col, text_col, digits).select(
        id_col, best["class"].alias("pred"), (-best["minus"]).alias("score"))


def nb_scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", digits: int = 6) -> DataFrame:
    """(id, labels) with all labels of a document, best first: an
    array of (label, score) as a classification result holds it. Scores are
    probabilities that add up to 1, from log scores by the log-sum-exp of
    their differences to the best one, so that nothing overflows or vanishes;
    ties go to the smaller class."""
    scored = _nb_scored(docs, model, id_col, text_col, digits)
    top = F.element_at("_scores", 1)["minus"]
    total = F.aggregate("_scores", F.lit(0.0), lambda acc, c: acc + F.exp(top - c["minus"]))
    labels = F.transform("_scores", lambda c: F.struct(c["class"].cast("string").alias("label"),
                                                       F.round(F.exp(top - c["minus"]) / total, digits).alias("score")))
    return scored.select(id_col, labels.alias("labels"))


def keywords_mmr(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 candidates: int = 20, top_n: int = 10, diversity: float = 0.7,
                 stop_words=None) -> DataFrame:
    """M4: pick ``top_n`` of the ``candidates`` best TF-IDF grams per
    document by greedy MMR: (1-diversity)*relevance - diversity*max
    similarity to the grams already chosen; relevance = score / best
    score of the document, similarity = token Jaccard; ties go to the
    better TF-IDF rank. (id, rank, gram, score)."""
    cand = keywords_tfidf(docs, id_col, text_col, top_n=candidates, stop_words=stop_words)
    cand = cand.groupBy(id_col).agg(F.max("score").alias("_top"), F.array_sort(F.collect_list(F.struct(
        "rank", "gram", "score", F.array_distinct(F.split("gram", " ")).alias("toks")))).alias("_c"))

    def value(c: Column, chosen: Column) -> Column:
        relevance = F.when(F.col("_top") > 0, c["score"] / F.col("_top")).otherwise(0.0)
        alike = F.transform(chosen, lambda h: F.size(F.array_intersect(h["toks"], c["toks"])) / F.size(F.array_union(h["toks"], c["toks"])))
        return F.round((1 - diversity) * relevance - diversity * F.coalesce(F.array_max(alike), F.lit(0.0)), 12)

    def pick(chosen: Column, _: Column) -> Column:
        left = F.filter("_c", lambda c: ~F.exists(chosen, lambda h: h["rank"] == c["rank"]))
        valued = F.transform(left, lambda c: F.struct(value(c, chosen).alias("v"), (-c["rank"]).alias("r"), c.alias("c")))
        return F.when(F.size(chosen) < F.size("_c"), F.concat(chosen, F.array(F.array_max(valued)["c"]))).otherwise(chosen)

    empty = F.slice("_c", 1, 0)
    picked = F.aggregate(F.sequence(F.lit(1), F.lit(top_n)), empty, pick)
    out = cand.select(id_col, F.posexplode(picked).alias("_p", "c"))
    return out.select(id_col, (F.col("_p") + 1).cast("int").alias("rank"), F.col("c.gram").alias("gram"), F.col("c.score").alias("score"))


def keywords_maxsum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    candidates: int = 20, top_n: int = 10, stop_words=None) -> DataFrame:
    """M3/M4: of the ``candidates`` best TF-IDF grams of a document the
    ``top_n`` whose pairwise similarities (token Jaccard) have the least sum
    (of equal sums the set whose ranks come first); all of them where there
    are fewer. (id, rank, gram, score, alike): in TF-IDF order; alike is the
    sum, which is the same in all rows of a document."""
    cand = keywords_tfidf(docs, id_col, text_col, top_n=candidates, stop_words=stop_words)
    cand = cand.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "gram", "score"))).alias("_c"))
    chosen = least_alike(cand, F.transform("_c", lambda c: F.split(c["gram"], " ")), top_n, "_places", "_alike")
    out = chosen.select(id_col, "_c", F.posexplode("_places").alias("_p", "_at"), "_alike")
    best = F.element_at("_c", F.col("_at") + 1)
    return out.select(id_col, (F.col("_p") + 1).cast("int").alias("rank"), best["gram"].alias("gram"),
                      best["score"].alias("score"), F.col("_alike").alias("alike"))
