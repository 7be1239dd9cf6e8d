"""Keywords by blocks of tokens: the same rows as a plain loop whatever the
blocks and slices, and no row or shuffle for every gram of a document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from newsflow.functions.text import STOP_WORDS
from newsflow.operators import grams as G
from newsflow.operators import text as Tx
from newsflow.operators.text import round_half_up


def plain(docs, n):
    """The best grams of every id by a loop over (id, text)."""
    held = []
    for i, text in docs:
        toks = [t for t in re.findall(r"\w+", (text or "").lower()) if t not in STOP_WORDS]
        held.append((i, Counter(toks) + Counter(f"{a} {b}" for a, b in zip(toks, toks[1:]))))
    df = Counter(g for _, c in held for g in c)
    rows = {}
    for i, c in held:
        rows.setdefault(i, []).extend((-round_half_up(tf * math.log((len(docs) + 1) / (df[g] + 1)), 9), g, tf, df[g]) for g, tf in c.items())
    return sorted(((i, rank, g, tf, d, -s) for i, x in rows.items() for rank, (s, g, tf, d) in enumerate(sorted(x)[:n], 1)), key=str)


@pytest.mark.parametrize("block, slices", [(1, 2), (60, 4), (1 << 20, 64)])
def test_against_a_plain_loop(spark, monkeypatch, block, slices):
    monkeypatch.setattr(G, "BLOCK", block)
    monkeypatch.setattr(G, "LEAST_SLICES", slices)
    rng = random.Random(5)
    words = ["the", "é", "éa", "日本", "a_b", "a", "ab", "abc", "x1", "𝒳", "ﬁ", *"bcdefghij"]
    docs = [(i % 25, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 9, 40])))) for i in range(40)]
    docs += [(None, "b c"), (None, "b c d"), (70, None), (71, ""), (3, docs[3][1]), (72, "the the"), (73, "b " * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in Tx.keywords_tfidf(df, top_n=4).collect()), key=str)
    assert got == plain(docs, 4) and len(got) > 60


@pytest.mark.parametrize("job", [Tx.keywords_tfidf, Tx.keywords_maxsum, Tx.keywords_mmr])
def test_no_table_or_shuffle_of_all_grams(spark, monkeypatch, job):
    rng = random.Random(6)
    docs = [(i, " ".join("w%d" % rng.randrange(400) for _ in range(1_000))) for i in range(40)]
    written = []

    def counted(df, name="table"):
        out = materialize(df, name)
        written.append(out.count())
        return out

    materialize = Tx.materialize
    for module in (Tx, G):
        monkeypatch.setattr(module, "materialize", counted, raising=False)
    plan = job(spark.createDataFrame(docs, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert sum(written) < 2 * 8 * G.LEAST_SLICES           # and not some 50,000
    assert not re.search(r"hashpartitioning\(gram|BroadcastExchange", plan)


def test_numbers_are_packed():
    for x in ([], [0, 0], [1, 255, 3], [256, 0], [1 << 62, 5]):
        x = np.array(x, np.int64)
        assert G.unpacked(G.packed(x), len(x)).tolist() == x.tolist()
    assert len(G.packed(np.arange(256))) == 256 and len(G.packed(np.arange(257))) == 514


def test_scores_that_rounding_may_level_are_both_kept():
    row = np.array([0, 0, 0, 0, 1, 1, 1, 1, 1])
    score = np.array([5.0, 5.0 - 1e-10, 5.0 + 1e-10, 3.0, 2.0, 2.0, 2.0, 1.0, 9.0])
    place = np.array([3, 1, 2, 0, 5, 4, 6, 0, 9])
    assert sorted(G.chosen(row, score, place, 2, 1e-9).tolist()) == [0, 1, 2, 5, 8]
    assert sorted(G.chosen(row, score, place, 1, 1e-9).tolist()) == [0, 1, 2, 8]
    assert len(G.chosen(row[:0], score[:0], place[:0], 1, 1e-9)) == 0
