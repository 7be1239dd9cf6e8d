"""Spelling variants against a word-by-word comparison."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsflow.llm import queries as Q
from newsflow.llm import spelling as S

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def lower(run):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def brute(docs):
    seen = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def got(spark, docs):
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in S.group_variants(df).collect()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aAbÀ÷ÿ ,\nĀ", max_size=30)), st.integers(1, 7))
def test_runs(parts, piece):
    text = "".join(parts)
    assert S.run_counts(text, piece) == Counter(lower(r) for r in re.findall("[A-Za-zÀ-ÿ]+", text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé÷", min_size=1, max_size=9), min_size=1, max_size=12, unique=True))
def test_every_edit_is_generated_once(words):
    full = {n: np.full(1, 2**64 - 1, np.uint64) for n in range(0, 12)}     # passes everything
    letters = np.array(sorted({ord(c) for w in words for c in w}), np.uint64)
    made = [(words[p], e) for places, found in S.edits(words, full, letters) for p, e in zip(places, found)]
    assert len(made) == len(set(made))
    for w in words:
        mine = {e for x, e in made if x == w}
        cut = {w[:i] + w[i + 1:] for i in range(len(w))} if len(w) > 1 else set()
        put = {w[:i] + chr(c) + w[i + 1:] for i in range(len(w)) for c in letters.tolist() if chr(c) > w[i]}
        assert mine == cut | put


def corpus(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdéÿ÷") for _ in range(rng.randint(4, 9))) for _ in range(25)] + ["x" * 70, "x" * 71, "y" * 64, "y" * 63]
    docs = [(None, None), (1, ""), (2, " ,. "), (3, "a" * 300 + " ok"), (None, "hello hello hello hallo hallo hallo hello hello hello")]
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 25)):
            w = rng.choice(stems[:1 + int(28 * rng.random() ** 2)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(["", "a", "é"]) + w[at + rng.randint(0, 1):]
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        docs.append((rng.randint(0, 60), rng.choice([" ", ", ", "-1-"]).join(words)))
    return docs + docs[10:14]


def test_variants_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 50)
    monkeypatch.setattr(S, "ROWS_OUT", 40)
    monkeypatch.setattr(S, "PROBES", 3000)
    docs = corpus(3)
    assert got(spark, docs) == brute(docs)


def test_full_filters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_BLOCKS", 1)      # nearly everything passes; the join decides
    docs = corpus(4)
    assert got(spark, docs) == brute(docs)


def test_chains_lead_to_their_end(spark):
    docs = [(i, " ".join(w for k, w in enumerate(["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]) for _ in range(3 * 2 ** k)))
            for i in range(1)]
    out = got(spark, docs)
    assert out == brute(docs)
    assert out["aaaaa"][1] == "bbbbb"


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.group_variants(empty).collect() == []
    rare = spark.createDataFrame([(1, "words that are seldom")], "doc_id long, text string")
    assert S.group_variants(rare).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_query_against_sql(spark):
    from scripts.compare import canon, duck
    name = "op12_spelling_variants"
    assert canon(Q.QUERIES[name](spark, SF).toPandas()) == canon(duck(SF).sql(Q.SQL[name]).df())
