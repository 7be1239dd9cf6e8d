"""Line dedup and mixing against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsflow.llm import line_dedup as L
from newsflow.llm import mixing
from newsflow.llm.queries import MIX_DIMS, shape_topic


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=600, deadline=None)
@given(st.text("ab", max_size=14), st.text("ab", max_size=14), st.integers(0, 4))
def test_banded_distance(a, b, most):
    assert L.edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)


@settings(max_examples=400, deadline=None)
@given(st.text("abc", min_size=10, max_size=60), st.data())
def test_close_lines_meet_under_a_key(a, data):
    b = list(a)
    for _ in range(data.draw(st.integers(0, 2))):
        at = data.draw(st.integers(0, max(len(b) - 1, 0)))
        change = data.draw(st.sampled_from("+-="))
        if change == "+":
            b.insert(at, "x")
        elif b and change == "-":
            b.pop(at)
        elif b:
            b[at] = "y"
    b = "".join(b)
    short, long_ = sorted([a, b], key=len)
    if len(short) < L.MIN_CHARS or levenshtein(a, b) > L.allowed(len(short)):
        return
    keys = lambda s: [(seed, s[at:at + n], i) for seed, at, n, i in L.probes(len(s))]
    filed = {k[:2] for k in keys(short) if k[2]}
    assert len(filed) == L.allowed(len(short)) + 1
    assert filed & {k[:2] for k in keys(long_)}


def brute(docs):
    """The report, from all pairs of different lines."""
    key = lambda i, at, t: (i is None, i or 0, at)
    where = {}
    for i, t in docs:
        for at, line in enumerate((t.split("\n") if t is not None else [])):
            if len(line) >= L.MIN_CHARS:
                where.setdefault(line, []).append((key(i, at, t), i, at))
    root, degree = {line: line for line in where}, dict.fromkeys(where, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(where, 2):
        if abs(len(a) - len(b)) <= 2 and levenshtein(a, b) <= L.allowed(min(len(a), len(b))):
            root[find(a)] = find(b)
            degree[a] += 1
            degree[b] += 1
    kept = {}
    for line, places in where.items():
        kept[find(line)] = min(kept.get(find(line), min(places)), min(places))
    out, texts = [], {}
    for i, t in docs:
        lines = t.split("\n") if t is not None else []
        gone = [(at, kept[find(x)][1]) for at, x in enumerate(lines) if x in where and kept[find(x)][0] != key(i, at, t)]
        out.append((i, len(lines), len(gone), sum(degree.get(x, 0) for x in lines), [g[0] for g in gone], [g[1] for g in gone]))
        if not gone or len(gone) < len(lines):
            texts[i] = "\n".join(x for at, x in enumerate(lines) if at not in {g[0] for g in gone}) if t is not None else None
    return out, texts


def documents():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgé日") for _ in range(rng.randint(2, 7)))
    pool = [" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(30)] + ["short", "", "0123456789", "012345678x"]

    def near(line):
        out = list(line)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(out) + 1)
            out[at:at + rng.randint(0, 1)] = rng.choice(["", "q"])
        return "".join(out)
    docs = [(i, "\n".join(near(rng.choice(pool)) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "\n\n"), (73, "only short\nlines"), (74, docs[3][1]), (75, "x" * 1_500), (76, "x" * 1_501),
             (None, docs[5][1] + "\nand a line without an id"), (77, "and a line without an id!"), (78, "aaaaaaaaaaaaaaaaaaaaaaaa"), (79, "aaaaaaaaaaaaaaaaaaaaaaaaaa")]
    return docs


@pytest.mark.parametrize("group, most", [(L.GROUP, L.BROADCAST_ROWS), (3, 0)])
def test_lines_against_all_pairs(spark, monkeypatch, group, most):
    # the second case deals keys over blocks and joins by shuffle
    monkeypatch.setattr(L, "GROUP", group)
    monkeypatch.setattr(L.bounded, "__defaults__", (most,))
    docs = documents()
    want, texts = brute(docs)
    df = spark.createDataFrame([(i, t, "x", i) for i, t in docs], "doc_id long, text string, gone string, key long")
    got = [tuple(r) for r in L.line_report(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = L.dedup_lines(df)
    assert left.columns == df.columns
    assert {r.doc_id: r.text for r in left.collect()} == texts


def test_rows_repeated_as_a_whole_are_cut_alike(spark):
    df = spark.createDataFrame([(5, "a line of some length\nother line here")] * 3 + [(6, "a line of some length")], "doc_id long, text string")
    assert sorted(map(tuple, L.line_report(df).collect())) == [(5, 2, 0, 0, [], [])] * 3 + [(6, 1, 1, 0, [0], [5])]
    assert sorted(r.doc_id for r in L.dedup_lines(df).collect()) == [5, 5, 5]


def test_no_lines(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.line_report(df).collect() == [] and L.dedup_lines(df).collect() == []


def mixed_docs(n=4000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["big"] * 12 + ["mid"] * 4 + ["small", None])
        lang = rng.choice(["en"] * 6 + ["de", "fr", None])
        topic = rng.choice(["news", "news", "code"])
        text = rng.choice([None, " "] + ["w " * rng.randint(1, 80)] * 30)
        rows.append((i, text, source, lang, topic, "kept"))
    return rows


def test_raking_meets_all_margins_and_the_budget(spark):
    rows = mixed_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string, probability string")
    out = ("n", "p", "yes")
    got = mixing.mix(df, MIX_DIMS, 0.3, temper=0.8, out=out).collect()
    assert len(got) == len(rows) and {r.probability for r in got} == {"kept"}
    cells, total = {}, 0
    for r in got:
        assert r.n == len((r.text or "").split())
        cells.setdefault((r.source, r.lang, r.topic), [0, r.p])[0] += r.n
        total += r.n
    # numpy reference
    dims = [sorted({c[d] for c in cells}, key=str) for d in range(3)]
    w = np.zeros([len(d) for d in dims])
    for c, (n, _) in cells.items():
        w[tuple(dims[d].index(c[d]) for d in range(3))] = n
    tokens, targets = w.copy(), []
    for d in range(3):
        margin = w.sum(axis=tuple(x for x in range(3) if x != d)) ** 0.8
        targets.append(margin / margin.sum())
    for _ in range(500):
        for d in range(3):
            now = w.sum(axis=tuple(x for x in range(3) if x != d))
            w = w * np.expand_dims(targets[d] / now, tuple(x for x in range(3) if x != d))
    lo, hi = 0.0, 1e9
    for _ in range(200):
        s = (lo + hi) / 2
        p = np.minimum(1, s * w / tokens)
        lo, hi = (s, hi) if (p * tokens).sum() < 0.3 * total else (lo, s)
    for c, (_, got_p) in cells.items():
        assert abs(p[tuple(dims[d].index(c[d]) for d in range(3))] - got_p) < 1e-4
    taken = sum(r.n for r in got if r.yes)
    assert abs(taken / total - 0.3) < 0.03
    again = mixing.mix(df, MIX_DIMS, 0.3, temper=0.8, out=out).where("yes").select("doc_id").collect()
    assert {r.doc_id for r in again} == {r.doc_id for r in got if r.yes}


def test_sampling_edges(spark):
    df = spark.createDataFrame(mixed_docs(300), "doc_id long, text string, source string, lang string, topic string, probability string")
    everything = mixing.sample(df, MIX_DIMS, 1.0, temper=1.0)
    assert everything.columns == df.columns
    with_words = df.where(mixing.word_count("text") > 0)
    assert everything.where(mixing.word_count("text") > 0).count() == with_words.count()
    assert mixing.sample(df.limit(0), MIX_DIMS, 0.5).collect() == []
    blank = df.withColumn("text", F.lit(None).cast("string"))
    assert mixing.sample(blank, MIX_DIMS, 0.5).collect() == []
    wanted = {"source": spark.createDataFrame([("small", 3.0), (None, 1.0), ("absent", 9.0)], "value string, weight double")}
    few = mixing.sample(df, ["source"], 0.02, targets=wanted).select("source").distinct().collect()
    assert {r.source for r in few} <= {"small", None}


def test_topics(spark):
    texts = [None, " ", "a | b | c", "a! b? c. d, e.", "just words here", "w " * 200, "w " * 2000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(shape_topic().alias("t"))
    assert [r.t for r in df.collect()] == ["blank", "blank", "table", "marked", "short", "article", "long"]


def test_no_tokens_no_probability_and_clashing_names(spark):
    df = spark.createDataFrame(mixed_docs(200), "doc_id long, text string, source string, lang string, topic string, probability string")
    df = df.withColumns({"d0": F.lit("mine"), "_d1": F.col("doc_id"), "D2": F.lit(7)})
    got = mixing.mix(df, MIX_DIMS, 0.5, out=("n", "p", "yes"))
    assert got.columns == [*df.columns, "n", "p", "yes"]
    rows = got.collect()
    assert {(r.d0, r.D2) for r in rows} == {("mine", 7)} and all(r["_d1"] == r.doc_id for r in rows)
    blank = {(r.source, r.lang, r.topic) for r in rows} - {(r.source, r.lang, r.topic) for r in rows if r.n}
    for r in rows:
        if (r.source, r.lang, r.topic) in blank:
            assert r.p == 0.0 and not r.yes
    alone = df.where(F.col("doc_id") < 3).withColumns({"text": F.when(F.col("doc_id") == 0, " "), "source": F.col("doc_id").cast("string")})
    assert {(r.n, r.p, r.yes) for r in mixing.mix(alone, MIX_DIMS, 0.5, out=("n", "p", "yes")).collect()} == {(0, 0.0, False)}


def test_mix_query_with_blank_texts(spark, tmp_path):
    from newsflow.llm import queries as Q
    rows = [(i, t, "s%d" % (i % 2), "en") for i, t in enumerate([None, " ", "", *["some words here"] * 40])]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.QUERIES["op9_source_mix"](spark, str(tmp_path)).collect()
    assert len(got) == 43
    for r in got:
        if r.doc_id < 3:
            assert (r.topic, r.n_tokens, r.probability, r.taken) == ("blank", 0, 0.0, False)
