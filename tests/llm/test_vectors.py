"""Vector searches against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsflow.llm import ann_forest, topk_covertree, vectors

SCHEMA = "vec_id long, embedding array<float>, score string"


def fixture(n=400, dim=8, seed=0, copies=60):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, dim))
    rows[rng.integers(0, n, copies)] = rows[3]  # a vector many rows repeat
    rows = rows.astype(np.float32)
    return [(int(i), [float(x) for x in r], "kept") for i, r in enumerate(rows)]


ODD = [(1000, None, None), (1020, [0.0] * 8, ""), (1040, [1.0] * 7 + [None], ""), (1060, [1.0] * 7 + [math.nan], ""),
       (1080, [1.0] * 7 + [math.inf], ""), (None, [1.0] * 8, ""), (1100, [], ""), (1120, [1.0, 2.0], ""), (1121, [1.0, 3.0], "")]


def usable(rows, zero):
    out = []
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out.append((i, np.asarray(v, np.float32).astype(float)))
    return out


def brute(rows, every, k, score, largest):
    want = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        best = {}
        for qi, a in rows:
            for i, b in rows:
                if qi == q and i != q and len(a) == len(b):
                    s = score(a, b)
                    if i not in best or (s > best[i]) == largest:
                        best[i] = s
        order = sorted(best.items(), key=lambda x: (-x[1] if largest else x[1], x[0]))[:k]
        want += [(q, r + 1, i, s) for r, (i, s) in enumerate(order)]
    return want


@pytest.fixture(params=[vectors.SPREAD_ROWS, 100])
def spread(request, monkeypatch):
    monkeypatch.setattr(vectors, "SPREAD_ROWS", request.param)


REPEATED = [(20, [0.5] * 8, "a"), (20, [0.5] * 8, "a"), (20, [-0.5] * 8, "b"), (40, [0.25] * 8, "b")]


def test_cover_tree_is_exact(spark, spread):
    rows = fixture() + ODD + REPEATED
    df = spark.createDataFrame(rows, SCHEMA)
    quantise = lambda v: [math.floor(64 * x) for x in v]
    want = brute([(i, quantise(v)) for i, v in usable(rows, True)], 20, 20, lambda a, b: sum(x * y for x, y in zip(a, b)), True)
    got = topk_covertree.top_products(df, F.col("id") % 20 == 0, k=20)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk_covertree.top_products(df.limit(0), F.col("id") % 20 == 0).collect() == []


def test_forest_with_enough_candidates_is_exact(spark, spread):
    rows = fixture() + ODD + REPEATED
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(usable(rows, False), 20, 10, lambda a, b: math.sqrt(((a - b) ** 2).sum()), False)
    got = sorted(map(tuple, ann_forest.nearest(df, F.col("id") % 20 == 0, k=10).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
    np.testing.assert_allclose([r[3] for r in got], [r[3] for r in sorted(want)], rtol=1e-12)
    assert ann_forest.nearest(df.limit(0), F.col("id") % 20 == 0).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_dual_search_on_wide_integers(seed):
    rng = np.random.default_rng(seed)
    scale = [3, 1 << 20, 1 << 26, 1 << 28][seed]
    rows = rng.integers(-scale, scale, (700, 6))
    rows[100:140] = rows[5]
    ids = np.arange(700) * 3
    qs, q_ids = rows[::7], ids[::7]
    search = topk_covertree._index(ids, rows, 9)
    q, found, score = search(q_ids, qs)
    for n, (qid, query) in enumerate(zip(q_ids, qs)):
        exact = sorted((-sum(int(a) * int(b) for a, b in zip(query, r)), int(i)) for i, r in zip(ids, rows) if i != qid)[:9]
        assert sorted((-int(s), int(i)) for s, i in zip(score[q == n], found[q == n])) == exact


def test_cover_tree_covers_and_orders_all_points():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(size=(3000, 5)), np.zeros((500, 5))])
    tree = topk_covertree.CoverTree(rows, 32)
    assert sorted(tree.order) == list(range(len(rows)))
    for (lo, hi), centre, radius, children in zip(tree.span, tree.centre, tree.radius, tree.children):
        assert np.sqrt(((tree.rows[lo:hi] - centre) ** 2).sum(axis=1)).max() <= radius + 1e-9
        if children:
            spans = sorted(tree.span[c] for c in children)
            assert spans[0][0] == lo and spans[-1][1] == hi and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_forest_recall_on_unstructured_vectors(spark):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(6000, 64))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {}
    # few candidates: the trees have to find them
    for r in ann_forest.nearest(df, F.col("id") % 100 == 0, k=10, candidates=64, candidate_share=0.6).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in got:
        d = ((rows - rows[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert len(got) == 60 and hits / 600 >= 0.9
