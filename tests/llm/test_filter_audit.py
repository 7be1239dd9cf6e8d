"""The filter audit against a document-by-document count of all orders."""

import os
import random
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsflow.llm import filter_audit as A
from newsflow.llm import queries as Q
from newsflow.llm.words import word_chunks

SF = "/root/testdata/sf0.001"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b" ", b"\n", b"\x0b", b"a", b"bc", "é ".encode(), b"\x1f"]), max_size=60), st.integers(1, 9))
def test_word_chunks(parts, piece):
    data = b"".join(parts)
    assert [w for some in word_chunks(data, piece) for w in some] == data.split()


def test_intervals_are_the_first_failing_step():
    orders = list(A.orders("ABCDE"))
    assert [o for _, o in orders] == list(permutations("ABCDE")) and [r for r, _ in orders] == list(range(120))
    seen = {}
    for mask, step, low, high in A.removal_intervals(5):
        for rank in range(low, high):
            assert (mask, rank) not in seen
            seen[mask, rank] = step
    for mask in range(1, 32):
        for rank, order in orders:
            assert seen[mask, rank] == next(i for i, f in enumerate(order, 1) if mask >> "ABCDE".index(f) & 1)


def fails(text, words):
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
        out.add("C")
    if any(c in "#$%&*|" for c in text):
        out.add("D")
    return out


def brute(docs, labels):
    import re
    body = {}
    for i, text, _ in docs:
        if i is not None:
            body.setdefault(text or "", []).append(i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    out = {}
    for i, text, part in docs:
        text = text or ""
        f = fails(text, re.findall(r"[^\x20\x09-\x0D]+", text))
        if i is not None and min(body[text]) < i:
            f.add("E")
        for order in permutations("ABCDE"):
            gone = False
            for step, x in enumerate(order, 1):
                c = out.setdefault((part or "", "".join(order), step), dict.fromkeys(
                    ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"], 0))
                c["redundant"] += x in f and gone
                c["unique_fails"] += f == {x}
                if x in f and not gone:
                    c["removed"] += 1
                    c["good_lost"] += i in good and i is not None
                    c["toxic_lost"] += i in toxic and i is not None
                    gone = True
                c["kept"] += not gone
    share = {}
    for (part, order, step), c in out.items():
        key = part, order[step - 1]
        share[key] = share.get(key, 0) + c["removed"]
    return {k: {**c, "shapley": share[k[0], k[1][k[2] - 1]]} for k, c in out.items()}


def test_audit_against_all_orders(spark):
    rng = random.Random(5)
    pool = [None, "", " \n\t", "A" * 30, "x " * 250, "é|", "#", "long " + " ".join(f"w{i}" for i in range(400)),
            "  ", " ".join(rng.choice("abcdefgh") for _ in range(300))]
    docs = [(rng.choice([None, *range(40)]), rng.choice(pool) if rng.random() < 0.7 else " ".join(
        rng.choice(["Aa", "b", "c%", "d" + str(j)]) for j in range(rng.choice([3, 250]))), rng.choice(["en", "de", None, ""]))
        for _ in range(120)]
    docs += [(7, "same", "en"), (7, "same", "en"), (9, "same", "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 40, 2), 4, 4, None]]
    ddf = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, mask string, ID int").drop("ID")
    ldf = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, good string")
    got = A.audit_documents(ddf, ldf).collect()
    want = brute(docs, labels)
    assert len(got) == len(want)
    for r in got:
        assert {k: r[k] for k in want[r.part, r.filter_order, r.step]} == want[r.part, r.filter_order, r.step], r
        assert r["filter"] == r.filter_order[r.step - 1]


def test_no_documents_and_no_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit_documents(docs, labels).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    rows = A.audit_documents(one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.removed for r in rows) == 120


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_query_against_sql(spark):
    from scripts.compare import canon, duck
    name = "op11_filter_audit"
    assert canon(Q.QUERIES[name](spark, SF).toPandas()) == canon(duck(SF).sql(Q.SQL[name]).df())
