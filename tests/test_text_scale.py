"""Text jobs at size: counts in slices, sentences chosen for many documents at
once, a scorer without the vocabulary, and steps that are read twice but run
once."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsflow.functions.text import tokens
from newsflow.operators import scoring as Sc
from newsflow.operators import text as Tx
from newsflow.plans.catalog import QUERIES
from newsflow.session import scratch_path
from newsflow.streaming import jobs as X


def test_slices_of_a_batch_and_pairs():
    docs = [["a", "b", "a", "b"], None, [], ["b"], ["a", "b", "c"], ["c"] * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(docs, pa.list_(pa.string()))], names=["id", "t"])
    for most in (1, 4, 100):
        parts = list(Tx._slices(batch, 1, most))
        assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(6))
        got = {(p.column(0)[int(r)].as_py(), terms[int(t)].as_py()): int(n) for p in parts
               for terms, place, row, count in Tx.count_terms(p, True) for t, r, n in zip(place, row, count)}
        assert got == {(0, "a"): 2, (0, "b"): 2, (0, "a b"): 2, (0, "b a"): 1, (3, "b"): 1, (4, "a"): 1, (4, "b"): 1,
                       (4, "c"): 1, (4, "a b"): 1, (4, "b c"): 1, (5, "c"): 9, (5, "c c"): 8}


def test_sentences_of_all_documents_at_once():
    rng = random.Random(4)
    docs = [[[rng.choice("abcdefghij") for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(0, 12))] for _ in range(400)]
    docs += [None, [], [[]], [["a"]] * 5]
    for digits in (1, 3, 9):
        want, first = [], 0
        for i, toks in enumerate(docs):
            want += [(i, first + p, -minus) for minus, p in Tx.best_sentences(toks or [], 3, digits, False)]
            first += len(toks or [])
        got = Tx.chosen_sentences(pa.array(docs, pa.list_(pa.list_(pa.string()))), 3, digits)
        assert list(zip(*(x.tolist() for x in got))) == want


def test_a_scorer_without_the_vocabulary(spark):
    train = spark.createDataFrame([(1, "sun sun rain", "a"), (2, "rain snow", "b"), (3, "sun", "a")], "doc_id long, text string, k string")
    model = Tx.nb_train(train, "k")
    docs = spark.createDataFrame([(5, "sun rain snow snow"), (6, "nothing known"), (7, ""), (9, None)], "doc_id long, text string")
    weighed = Tx.nb_weighed(docs, model, tokens(F.coalesce("text", F.lit(""))), "weighed")
    load = Sc.naive_bayes_scorer(model, most=1, weighed=True)                  # more tokens than it may hold
    good, bad = Sc.score_resumable(weighed, load, "pred string, score double", scratch_path(spark, "t-nbw"), "doc_id", "weighed", parts=2)
    assert bad.count() == 0
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, Tx.nb_classify(docs, model).collect()))


def test_repeated_rows_are_not_counted_twice(spark):
    model = Tx.nb_train(spark.createDataFrame([("sun rain", "a"), ("snow", "b")], "text string, k string"), "k")
    docs = spark.createDataFrame([(1, "sun sun"), (1, "sun sun"), (1, "snow"), (None, "snow")], "doc_id long, text string")
    got = Tx.nb_weighed(docs, model, tokens("text"), "w").collect()
    assert sorted((str(r.doc_id), r.w[0]) for r in got) == [("1", 1.0), ("1", 2.0), ("1", 2.0), ("None", 1.0)]


def test_tokens_are_collected_after_their_shuffle_only(spark):
    """No set is gathered before the exchange, and no token goes through it."""
    model = Tx.nb_train(spark.createDataFrame([("sun rain", "a"), ("snow", "b")], "text string, k string"), "k")
    docs = spark.createDataFrame([(1, "sun snow"), (2, "sun")], "doc_id long, text string")
    lines = Tx.nb_weighed(docs, model, tokens("text"), "w")._jdf.queryExecution().sparkPlan().toString().split("\n")
    gathered = [i for i, line in enumerate(lines) if "partial_collect_set" in line]
    assert gathered and all("Exchange" in lines[i + 1] for i in gathered)
    assert all("token" not in lines[i] for i in gathered)


def test_documents_without_a_class(spark):
    """As the SQL has it: they count in the priors and the vocabulary, and the
    NULL class has no tokens and comes last of equals."""
    train = spark.createDataFrame([("sun sun rain", 1), ("rain snow", 0), ("fog", None), (None, None)], "text string, k int")
    model = Tx.nb_train(train, "k")
    docs = spark.createDataFrame([(5, "sun rain"), (6, "nothing known"), (7, "fog fog fog"), (8, None)], "doc_id long, text string")
    prior = {1: math.log(1 / 4), 0: math.log(1 / 4), None: math.log(2 / 4)}
    norm = {1: math.log(3 + 4), 0: math.log(2 + 4), None: math.log(0 + 4)}     # four tokens in all
    seen = {5: {1: math.log(3) + math.log(2), 0: math.log(2)}}
    known = {5: 2, 7: 3}
    score = {(d, k): round(prior[k] - known.get(d, 0) * norm[k] + seen.get(d, {}).get(k, 0.0), 6) for d in (5, 6, 7, 8) for k in prior}
    want = {d: max(((score[d, k], k is not None, k) for k in prior), key=lambda x: x[:2]) for d in (5, 6, 7, 8)}
    got = {r.doc_id: (r.score, r.pred is not None, r.pred) for r in Tx.nb_classify(docs, model).collect()}
    assert got == {d: (pytest.approx(w[0]), *w[1:]) for d, w in want.items()}
    assert all(len(r.labels) == 3 for r in Tx.nb_scores(docs, model).collect())
    weighed = Tx.nb_weighed(docs, model, tokens(F.coalesce("text", F.lit(""))), "weighed")
    load = Sc.naive_bayes_scorer(model, weighed=True)
    good, bad = Sc.score_resumable(weighed, load, "pred int, score double", scratch_path(spark, "t-nbn"), "doc_id", "weighed", parts=2)
    assert bad.count() == 0 and {r.doc_id: (r.score, r.pred is not None, r.pred) for r in good.collect()} == got


def test_the_class_of_none_is_the_last_of_equals(spark):
    model = Tx.nb_train(spark.createDataFrame([("sun", 1), ("", None)], "text string, k int"), "k")
    docs = spark.createDataFrame([(5, "x")], "doc_id long, text string")
    assert Tx.nb_classify(docs, model).first().pred == 1
    weighed = Tx.nb_weighed(docs, model, tokens("text"), "weighed")
    good, _ = Sc.score_resumable(weighed, Sc.naive_bayes_scorer(model, weighed=True), "pred int, score double",
                                 scratch_path(spark, "t-nbl"), "doc_id", "weighed", parts=1)
    assert good.first().pred == 1


@pytest.fixture
def tables(spark, tmp_path):
    texts = ["One two three. Two three! Four?", "Five six. Six.", None, ""]
    docs = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pages = [(i, f"https://a.example.org/{i % 2}", f"<title>t{i}</title><p>word{i} other</p>") for i in range(3)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


def test_pages_are_parsed_and_summaries_made_once(spark, tables):
    article = QUERIES["page_to_article"](spark, tables)
    plan = article._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in plan.lower() and {r.title for r in article.collect()} == {"t1", "t2"}
    replaced = QUERIES["upsert_replace"](spark, tables)
    assert "MapInArrow" not in replaced._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.title is None, r.summary is None) for r in replaced.collect()) == sorted(
        [(False, True), (False, False), (True, True), (True, True)])


def test_files_are_looked_up_by_few_tasks(spark):
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    with X.grouped_listing(spark):
        assert int(spark.conf.get(name)) <= 2 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(name) == before
