"""Repeated passages and the suffix sort against brute force."""

import random

import numpy as np
import pytest

from newsflow.llm import suffix_dedup as S


def brute(texts, length):
    seen = {}
    for t in texts:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            seen[raw[i:i + length]] = seen.get(raw[i:i + length], 0) + 1
    out = []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i:i + length]] > 1:
                gone[i:i + length] = True
        edge = np.flatnonzero(np.diff(np.r_[False, gone[:-1], False].astype(int)))
        out.append(([(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])], bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])))
    return out


def corpus(seed, length):
    rng = random.Random(seed)
    new = lambda n: "".join(rng.choice("abcdé 日") for _ in range(n))
    passages = [new(rng.randint(length // 4, 4 * length)) for _ in range(8)] + ["ab" * length, "x" * 3 * length]
    texts = [None, "", "short", new(length), "y" * (length - 1), "y" * length]
    for _ in range(45):
        parts = [new(rng.randint(0, 2 * length)) if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randint(1, 5))]
        texts.append("".join(parts))
    texts += [texts[8]] * 2 + [texts[9] + "!", passages[0], passages[0][:length + 3], "z" * (length + 1), "q" + "w" * (5 * length)]
    long_ = new(20 * length)
    return texts + [long_, long_[:9 * length] + "?" + long_[9 * length:]]


@pytest.mark.parametrize("length, gram, group, piece", [(40, 12, 4000, 1 << 19), (40, 16, 2, 64), (64, 32, 4000, 1 << 19)])
def test_spans_against_all_strings(spark, monkeypatch, length, gram, group, piece):
    # the second case cuts long documents into pieces and compares hot pieces over all tasks
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "PIECE", piece)
    texts = corpus(length + gram, length)
    df = spark.createDataFrame(list(enumerate(texts)), "sid long, text string")
    got = S.remove_repeats(df, "text", length, gram)
    assert got.columns == ["sid", "text", "spans", "kept"]
    by = {r.sid: ([(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got.collect()}
    want = brute(texts, length)
    assert len(by) == len(texts)
    for i, w in enumerate(want):
        assert by[i] == w, (i, texts[i][:80])


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(df).collect() == []


@pytest.mark.parametrize("reach, letters", [(10 ** 6, "ab"), (4, "ab"), (10 ** 6, "abcdefgh")])
def test_suffix_ranks(spark, reach, letters):
    rng = random.Random(reach)
    strings = {s: "".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for s in range(12)}
    strings |= {20: "a" * 30, 21: "a" * 30, 22: "ab" * 15, 23: "a", 24: "b"}
    rows = [(s, i, ord(c) - 96, 1) for s, t in strings.items() for i, c in enumerate(t)]
    df = spark.createDataFrame(rows, "s long, i long, c long, size long")
    got = {(r.s, r.i): r.rank for r in S.suffix_ranks(df, reach).collect()}
    suffixes = {(s, i): strings[s][i:] for s, i, *_ in rows}
    assert got.keys() == suffixes.keys()
    order = sorted(suffixes.values())
    if reach > 40:
        first = {}
        for n, x in enumerate(order):
            first.setdefault(x, n)
        assert got == {k: first[x] for k, x in suffixes.items()}
    else:  # suffixes that differ early keep their order
        ranked = sorted(suffixes, key=got.get)
        for a, b in zip(ranked, ranked[1:]):
            assert suffixes[a][:reach] <= suffixes[b][:reach]
            if got[a] == got[b]:
                assert suffixes[a][:reach] == suffixes[b][:reach]


def test_anchors_follow_the_string_alone():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 4, 60, dtype=np.uint8)
    for seed in range(20):
        rng = np.random.default_rng(seed)
        data = np.concatenate([rng.integers(0, 4, rng.integers(0, 200), dtype=np.uint8), passage, rng.integers(0, 4, 50, dtype=np.uint8)])
        pos, lo, hi, piece = S.anchors(data, 60, 8)
        start = len(data) - 110
        j = int(np.flatnonzero((lo <= start) & (start <= hi))[0])
        alone = S.anchors(passage, 60, 8)
        assert pos[j] - start == alone[0][0] and piece[j] == alone[3][0]
        assert lo[0] == 0 and hi[-1] == len(data) - 60 and (lo[1:] == hi[:-1] + 1).all()


def test_string_hashes_are_position_free():
    data = np.frombuffer(b"0123abcabc__abcabcxx", np.uint8)
    h1, h2 = S.string_hashes(data, np.array([4, 12, 5]), 6)
    assert h1[0] == h1[1] != h1[2] and h2[0] == h2[1] != h2[2]


def test_nested_columns_stay(spark):
    df = spark.createDataFrame([(1, "a" * 900, [1, None]), (2, "b", None)], "t1 long, text string, raw array<int>")
    got = S.remove_repeats(df).orderBy("t1").collect()
    assert [(r.t1, r.raw, len(r.kept)) for r in got] == [(1, [1, None], 0), (2, None, 1)]
