"""Max-sum selection against all choices."""

import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsflow.operators import maxsum as M
from newsflow.operators import text as Tx


def brute(alike, k):
    n = len(alike)
    if k >= n:
        return list(range(n)), int(np.triu(alike, 1).sum())
    cost, places = min((sum(alike[i][j] for i, j in combinations(c, 2)), c) for c in combinations(range(n), k))
    return list(places), int(cost)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 9), st.integers(0, 9), st.integers(0, 10_000), st.sampled_from([1, 3, 1_000_000]))
def test_least_sum_and_ties(n, k, seed, top):
    rng = np.random.default_rng(seed)
    a = np.triu(rng.integers(0, top + 1, (n, n)), 1)
    a = a + a.T
    assert M.choose(a, k) == brute(a, k)


def test_full_size():
    rng = np.random.default_rng(3)
    a = np.triu(rng.integers(0, 4, (20, 20)), 1) * 250_000
    a = a + a.T
    places, cost = M.choose(a, 10)
    assert len(places) == 10 and cost == sum(a[i][j] for i, j in combinations(places, 2))
    for _ in range(3000):       # no other choice is cheaper
        c = sorted(rng.choice(20, 10, replace=False).tolist())
        other = sum(a[i][j] for i, j in combinations(c, 2))
        assert other > cost or (other == cost and c >= places)
    with pytest.raises(ValueError):
        M.choose(np.zeros((25, 25), np.int64), 3)


def test_similarities():
    s = M.similarities([["a"], ["a", "b"], ["b", "c"], ["a", "a"], [], []])
    assert s[0].tolist() == [0, 500_000, 0, 1_000_000, 0, 0]
    assert s[1].tolist() == [500_000, 0, 333_333, 500_000, 0, 0]
    assert s[4].tolist() == [0] * 6


def test_keywords(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) for _ in range(rng.choice([0, 1, 3, 40])))) for i in range(30)]
    df = spark.createDataFrame([*docs, (99, None)], "doc_id long, text string")
    cand = {}
    for r in Tx.keywords_tfidf(df, top_n=9).collect():
        cand.setdefault(r.doc_id, {})[r["rank"]] = (r.gram, r.score)
    got = {}
    for r in Tx.keywords_maxsum(df, candidates=9, top_n=4).collect():
        got.setdefault(r.doc_id, {})[r["rank"]] = (r.gram, r.score, r.alike)
    assert got.keys() == cand.keys()
    for i, grams in cand.items():
        grams = [grams[j] for j in range(1, len(grams) + 1)]
        places, cost = brute(M.similarities([g.split() for g, _ in grams]), 4)
        assert got[i] == {j: (*grams[p], cost / M.SCALE) for j, p in enumerate(places, 1)}


def test_no_rows_and_no_text_in_a_later_exchange(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert Tx.keywords_maxsum(empty).collect() == []
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string").withColumn("_items", F.lit(1))
    assert Tx.keywords_maxsum(df, candidates=3, top_n=1).count() == 1
