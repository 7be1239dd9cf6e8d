"""Filed segments, packed filters and skewed keys of line dedup."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsflow.llm import bloom
from newsflow.llm import line_dedup as L

from .test_long_lines import edited


def test_segments_are_even_and_hold_a_window():
    size = np.arange(L.LONG, 5_000)
    line, start = L._segment_starts(size)
    for n in (80, 99, 100, 119, 120, 257, 258, 4_999):
        mine = start[line == n - L.LONG]
        cuts = np.r_[mine, n]
        assert len(mine) == L.allowed(n) + 1 and mine[0] == 0
        assert set(np.diff(cuts)) <= {n // len(mine), n // len(mine) + 1}
        assert np.diff(cuts).min() >= L.GRAM + L.WINDOW - 1
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            for at in (a, b - 1):
                assert L._segment_of(np.array([n]), np.array([at])).tolist() == [i]


def test_each_segment_is_filed_once_and_among_the_looked_up():
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcdé日 ") for _ in range(rng.randint(80, 700))) for _ in range(40)] + ["-" * 300, "ab" * 200]
    line, at, key, filed = L.anchor_keys(lines)
    every = set(zip(line.tolist(), at.tolist(), key.tolist()))
    only = L.anchor_keys(lines, filed_only=True)
    want = set(zip(*(x.tolist() for x in only[:3])))
    assert only[3].all() and want <= every
    assert want == set(zip(line[filed].tolist(), at[filed].tolist(), key[filed].tolist()))
    assert np.bincount(only[0]).tolist() == [L.allowed(len(x)) + 1 for x in lines]


def test_grams_do_not_depend_on_their_neighbours():
    rng = random.Random(4)
    a = "".join(rng.choice("abcdefgh ") for _ in range(400))
    b = "x" * 90
    alone = L.anchors([a])
    beside = L.anchors([b, a, b])
    mine = beside[0] == 1
    assert [x.tolist() for x in alone[1:]] == [x[mine].tolist() for x in beside[1:]]


@pytest.mark.parametrize("blocks", [bloom.SLICES, 3 * bloom.SLICES])
def test_gathered_filters_lose_no_hash(spark, blocks):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 5_000, dtype=np.uint64) * np.uint64(2)
    parts = [h[:3_000], h[2_000:], np.repeat(h[-5:], 2), h[:0], np.array([0, (1 << 64) - 1], np.uint64)]
    rows = [(s, b) for part in parts for r in bloom.packed([part]) for s, b in zip(*(c.to_pylist() for c in r.columns))]
    once, twice = bloom.gather(spark.createDataFrame(rows, bloom.PACKED), blocks)
    assert len(once) == len(twice) == blocks
    assert all(bloom.contains(once, p).all() for p in parts)
    assert bloom.contains(twice, h[2_000:3_000]).all() and bloom.contains(twice, h[-5:]).all()
    others = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert bloom.contains(once, others).mean() < 0.5 and (once & twice == twice).all()


def test_full_filters_change_no_link(spark, monkeypatch):
    # one block per slice for many keys: nearly every row passes
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 400))) for _ in range(120)]
    lines = sorted({x for b in base for x in (b, edited(b, rng.randint(1, 6), rng))})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    want = {tuple(r) for r in L.links(df).collect()}
    monkeypatch.setattr(L.bloom, "contains", lambda blocks, h: np.ones(len(h), bool))
    monkeypatch.setattr(L, "FILTER_BLOCKS", bloom.SLICES)
    assert {tuple(r) for r in L.links(df).collect()} == want and len(want) > 60


def test_rows_are_shuffled_once(spark, monkeypatch):
    """The keys with many lines come to the rows, which are shuffled by the keys
    of their blocks only; past ``HOT_KEYS`` both are shuffled, with the same rows."""
    monkeypatch.setattr(L, "GROUP", 64)
    rows = L.materialize(spark.range(600).select(
        F.when(F.col("id") < 300, 7).otherwise(F.col("id")).cast("long").alias("key"), (F.col("id") * 2).alias("line")), "t-hits")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before, got = spark.conf.get(name), []
    spark.conf.set(name, "-1")
    try:
        for most, shuffles in ((L.HOT_KEYS, 1), (0, 3)):
            monkeypatch.setattr(L, "HOT_KEYS", most)
            dealt = L._dealt(rows, rows, F.col("line"))
            plan = dealt._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == shuffles
            got.append(sorted(map(tuple, dealt.collect())))
    finally:
        spark.conf.set(name, before)
    assert got[0] == got[1] and len(got[0]) > 600


def test_a_hot_key_is_dealt_over_blocks(spark, monkeypatch):
    # one opening of a third of all lines; groups of 64 lines count a half of them
    monkeypatch.setattr(L, "GROUP", 64)
    rng = random.Random(11)
    opening = "this opening stands before a third of all lines of the table "
    tail = lambda: "".join(rng.choice("abcdefghijkl ") for _ in range(160))
    lines = [opening + tail() for _ in range(300)] + [tail() for _ in range(600)]
    lines += [edited(x, 4, rng) for x in lines[:40]]
    lines = sorted(set(lines))
    most = [L.allowed(len(x)) for x in lines]
    want = {frozenset((a, b)) for i, a in enumerate(lines) for j, b in enumerate(lines[i + 1:], i + 1)
            if a[-12:] == b[-12:] or a[:90][-20:] == b[:90][-20:] or a[60:75] == b[60:75]
            if L.edit_distance(a, b, min(most[i], most[j])) <= min(most[i], most[j])}
    number = {L.xxhash.xxh64_intdigest(x, 42): x for x in lines}
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {frozenset(number[x & (1 << 64) - 1] for x in r) for r in L.links(df).collect()}
    assert want <= got and len(got) >= 40
    assert all(L.edit_distance(*sorted(p, key=len)[::-1], 12) <= 12 for p in got)
