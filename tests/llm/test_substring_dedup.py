"""Repeated word windows against a window-by-window comparison."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsflow.llm import queries as Q
from newsflow.llm import substring_dedup as S

SF = "/root/testdata/sf0.001"


def brute(spark, docs, window):
    """docs: (id, text). Documents without an id come last, those of one id
    by the engine's 64-bit hash of their text."""
    texts = sorted({t for _, t in docs if t})
    ties = {}
    if texts:
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
        ties = {r.t: r.h for r in rows}
    first = {}
    keys = [(i is None, i or 0, ties.get(t, 0)) for i, t in docs]
    words = [(t or "").encode().split() for _, t in docs]
    for key, w in zip(keys, words):
        for s in range(len(w) - window + 1):
            x = tuple(w[s:s + window])
            first[x] = min(first.get(x, (key, s)), (key, s))
    out = []
    for key, w, (i, t) in zip(keys, words, docs):
        gone = [False] * (len(w) + 1)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (key, s):
                gone[s:s + window] = [True] * window
        spans, at = [], None
        for p, g in enumerate(gone):
            if g and at is None:
                at = p
            if not g and at is not None:
                spans.append((at, p))
                at = None
        kept = None if t is None else b" ".join(x for x, g in zip(w, gone) if not g).decode()
        out.append((i, t, len(w), tuple(spans), kept))
    return sorted(out, key=str)


def got(spark, docs, window, start):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, marks int, no_id string")
    found = S.remove_repeats(df, window=window, start=start)
    assert found.columns == ["doc_id", "text", "marks", "no_id", "n_words", "spans", "kept"]
    rows = found.collect()
    assert all(r.marks == 1 and r.no_id == "x" for r in rows)
    return sorted([(r.doc_id, r.text, r.n_words, tuple((s.start, s.end) for s in r.spans), r.kept) for r in rows], key=str)


def corpus(seed, window):
    rng = random.Random(seed)
    new = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("é日xyz") for _ in range(n))
    passages = [new(rng.randint(window // 2, 4 * window)) for _ in range(6)] + ["z " * 3 * window, "p q " * 2 * window]
    docs = [(None, None), (None, "one two"), (1, ""), (2, " \n\t "), (3, new(window)), (4, new(window - 1)), (5, "w " * window)]
    for i in range(60):
        parts = [new(rng.randint(0, 2 * window)) if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randint(1, 5))]
        docs.append((rng.choice([None, rng.randint(-5, 40), rng.randint(-5, 40)]), rng.choice([" ", "\n", " \x0b "]).join(parts)))
    long_ = new(20 * window)
    docs += [docs[9], docs[9], (90, docs[10][1]), (None, docs[10][1]), (91, long_), (89, long_ + " tail"), (92, new(3) + " " + long_)]
    return docs


@pytest.mark.parametrize("window, start, group, piece", [(20, 5, 20_000, 1 << 19), (8, 2, 3, 40), (6, 3, 1, 1 << 19), (4, 1, 2, 64)])
def test_windows_against_all(spark, monkeypatch, window, start, group, piece):
    # small groups deal most leaders over blocks, small pieces cut documents
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "PIECE", piece)
    docs = corpus(window, window)
    assert got(spark, docs, window, start) == brute(spark, docs, window)


def test_full_filters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_BLOCKS", 1)
    docs = corpus(77, 8)
    assert got(spark, docs, 8, 2) == brute(spark, docs, 8)


def test_candidates_are_extended_around_their_leader():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 50, 400).astype(np.uint64)
    for length in (5, 10, 20):
        mine, at, _, _ = S.survivors(words, np.arange(381), 20, 5, {}, length)
        assert mine.tolist() == list(range(381))
        assert (at >= mine).all() and (at + length <= mine + 20).all()
        if length > 5:
            assert (at <= before).all() and (before + length // 2 <= at + length).all()
        before = at


def test_long_words(spark):
    docs = [(1, "a " * 30 + "b" * 5000 + " c d e f g h"), (2, "x " + "b" * 5000 + " c d e f g h " + "y" * 100), (3, "q" * 9000)]
    assert got(spark, docs, 4, 2) == brute(spark, docs, 4)


def test_no_survivors_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(empty).collect() == []
    docs = [(1, "a b c d e f g"), (2, "h i j k l m"), (3, None)]
    assert got(spark, docs, 4, 2) == brute(spark, docs, 4)
    clash = spark.createDataFrame([(1, "a", 5)], "doc_id int, text string, Spans int")
    assert S.remove_repeats(clash).columns == ["doc_id", "text", "n_words", "spans", "kept"]
    with pytest.raises(ValueError):
        S.remove_repeats(empty, window=20, start=6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_query_against_sql(spark):
    from scripts.compare import canon, duck
    name = "op13_substring_dedup"
    assert canon(Q.QUERIES[name](spark, SF).toPandas()) == canon(duck(SF).sql(Q.SQL[name]).df())
