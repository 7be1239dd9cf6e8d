"""Text jobs: nothing of a text in a shuffle, sentence choice with its
re-weighting, and the scores of all labels."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsflow.functions.text import tokens
from newsflow.operators import articles as Art
from newsflow.operators import text as Tx


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]


def test_counts_and_summaries_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "b a b. C c", "x"), (2, "", "y"), (3, None, "z"), (4, "one", "w")], "doc_id long, text string, more string")
    counts = Tx.term_counts(docs, "doc_id", tokens("text"), "token", "n")
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 1), (1, "b", 2), (1, "c", 2), (4, "one", 1)]
    assert exchanges(counts) == [] and exchanges(Tx.summarize(docs)) == []
    model = Tx.nb_train(docs.where("doc_id < 3").withColumn("k", F.lit("a")), "k")
    for df in (Tx.nb_classify(docs, model), Tx.keywords_tfidf(docs), Tx.keywords_maxsum(docs)):
        assert not any(re.search(r"\btext#", line) for line in exchanges(df))


def plain(text, k, reweight):
    sents = [s.strip() for s in re.split(r"[.!?\n]+", text)]
    toks = [re.findall(r"[a-z]+", s.lower()) for s in sents if s]
    counts = Counter(t for x in toks for t in x)
    p = {t: c / sum(counts.values()) for t, c in counts.items()}
    chosen = {}
    while len(chosen) < k and any(x and i not in chosen for i, x in enumerate(toks)):
        score, at = min((-round(sum(p[t] for t in x) / len(x), 9), i) for i, x in enumerate(toks) if x and i not in chosen)
        chosen[at] = -score
        if reweight:
            for t in set(toks[at]):
                p[t] = p[t] * p[t]
    return sorted((i + 1, s) for i, s in chosen.items())


@pytest.mark.parametrize("reweight", [False, True])
def test_sentences_against_a_plain_loop(spark, reweight):
    rng = random.Random(9)
    texts = [". ".join(" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 9))) for _ in range(80)]
    texts += ["", " . ! ?", "a a a. b. a a a.", "one sentence only"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in Tx.summarize(df, k=4, reweight=reweight).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.score))
    for i, text in enumerate(texts):
        want = plain(text, 4, reweight)
        assert sorted(got.get(i, [])) == [(p, pytest.approx(s, abs=2e-9)) for p, s in want], text


def test_reweighting_by_hand():
    toks = [["a", "a"], ["a", "b"], ["c", "d"], []]
    # p(a) = 1/2, the others 1/6; after the first choice p(a) = 1/4
    assert Tx.best_sentences(toks, 2, 6, False) == [(-0.5, 0), (-0.333333, 1)]
    assert Tx.best_sentences(toks, 3, 6, True) == [(-0.5, 0), (-0.208333, 1), (-0.166667, 2)]
    assert Tx.best_sentences([], 2, 6, True) == [] and Tx.best_sentences([[]], 2, 6, False) == []


def test_all_labels_add_up_and_feed_the_tags(spark):
    rows = [(1, "sun sun rain", "good"), (2, "rain snow", "bad"), (3, "sun", "good"), (4, "fog", "dull")]
    train = spark.createDataFrame(rows, "doc_id long, text string, k string")
    model = Tx.nb_train(train, "k")
    docs = spark.createDataFrame([(9, "sun rain sun unknown"), (8, ""), (7, None), (6, "rain " * 5000)], "doc_id long, text string")
    counts = {k: Counter(t for _, x, c in rows if c == k for t in x.split()) for k in ("bad", "dull", "good")}
    vocabulary = {t for c in counts.values() for t in c}

    def want(text):
        logs = {k: math.log(sum(c == k for _, _, c in rows) / 4) + sum(
            math.log((counts[k][t] + 1) / (sum(counts[k].values()) + len(vocabulary))) for t in (text or "").split() if t in vocabulary)
            for k in counts}
        top = max(logs.values())
        total = sum(math.exp(v - top) for v in logs.values())
        return [(k, math.exp(logs[k] - top) / total) for k in sorted(logs, key=lambda k: (-round(logs[k], 6), k))]

    texts = {r.doc_id: r.text for r in docs.collect()}
    scored = Tx.nb_scores(docs, model)
    best = {r.doc_id: r.pred for r in Tx.nb_classify(docs, model).collect()}
    for r in scored.collect():
        assert [x.label for x in r.labels] == [k for k, _ in want(texts[r.doc_id])]
        assert [x.score for x in r.labels] == pytest.approx([p for _, p in want(texts[r.doc_id])], abs=2e-6)
        assert best[r.doc_id] == r.labels[0].label and sum(x.score for x in r.labels) == pytest.approx(1, abs=1e-5)
    results = scored.select("doc_id", F.to_json("labels").alias("body"))
    for r in Art.extract_tags(results).collect():
        assert r.tags == [x["label"] for x in json.loads(r.body)] and len(r.tags) == 3
