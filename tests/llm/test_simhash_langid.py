"""SimHash and language identification against plain references."""

import random
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from newsflow.llm import components, langid, simhash
from newsflow.llm.queries import held_out


def plain_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, max_bits):
    """{(row number): least id} by union over all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (i, (_, a)), (j, (_, b)) in combinations(enumerate(prints), 2):
        if (a ^ b).bit_count() <= max_bits:
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        known = least.get(find(i))
        least[find(i)] = doc if known is None else known if doc is None else min(known, doc)
    return [least[find(i)] for i in range(len(prints))]


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 6)))
    texts = [None, "", "  \t\n", "one", "One two", "ONE TWO\x0bthree", "a b c d", "A b  c\x0cd"]
    for _ in range(25):
        words = [word() for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            changed = list(words)
            changed[rng.randrange(len(words))] = word()
            texts.append(" ".join(changed))
    return [(i, t) for i, t in enumerate(texts)] + [(900, texts[9]), (901, texts[9]), (None, texts[9]), (None, "only null ids")]


def test_fingerprints_and_components(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, FP long, root string")
    want_print = [(i, plain_fingerprint(t, 4)) for i, t in rows]
    want = {(i, f"{f:016x}", c) for (i, f), c in zip(want_print, plain_components(want_print, 4))}
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows) and set(map(tuple, got)) == want
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({c for *_, c in want}, key=str)
    empty = df.limit(0)
    assert simhash.near_duplicates(empty).collect() == [] and simhash.drop_near_duplicates(empty).collect() == []


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(700))
    for chunk in (1, 7, 64, 1000):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        for t in (text, " " + text + "\n", "a" * 300, "a b", text.replace(" ", "  \t ")):
            assert simhash.fingerprint(t, 4) == plain_fingerprint(t, 4)


def test_triples_meet_every_four_positions():
    assert len(simhash.TRIPLES) == 20
    for four in combinations(range(8), 4):
        assert any(set(t) <= set(four) for t in simhash.TRIPLES)


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(8)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            prints.add(base)
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                base ^= 1 << bit
    prints |= {0, (1 << 64) - 1, 0xF, 1 << 63}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    order = sorted(signed(p) for p in prints)
    want = dict(zip(order, plain_components([(p, p % (1 << 64)) for p in order], 4)))
    for long_list in (50_000, 2):  # the second deals almost every list again
        roots = {r.node: r.root for r in components.components(simhash.links(df, 4, long_list)).collect()}
        assert {p: roots.get(p, p) for p in order} == want


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(7, 7), (300, 200), (300, 200)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)} | {200: 200, 300: 200}
    assert got == want
    assert components.components(df.limit(0)).collect() == []


LANGS = {"xa": "aeiou", "xb": "bdfgk", "xc": "éàüßñ"}


def labelled(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        words = ["".join(rng.choice(LANGS[lang] + "rst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 60))]
        out.append((i, " ".join(words), lang))
    return out


def test_languages_are_learned_and_rejected(spark):
    rows = labelled(900, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = df.where(~held_out())
    model = langid.train(train, per_class=150)
    assert model.classes == sorted(LANGS) and 0 < model.threshold < 1
    got = langid.identify(df.where(held_out()), model).select("lang", "lang_id.*").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert len(got) > 200 and right / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) / len(got) < 0.03
    # calibrated: the mean confidence is near the share of right answers
    assert abs(np.mean([r.score for r in got]) - right / len(got)) < 0.1

    edge = [(1, None, "kept"), (2, "", "kept"), (3, "123 ... !", "kept"), (4, "aei " * 200_000, "kept"), (4, "aei " * 200_000, "kept"),
            (5, "日本", "kept"), (None, "bdf gk", None)]
    found = langid.identify(spark.createDataFrame(edge, "doc_id long, text string, score string"), model).collect()
    assert len(found) == len(edge) and {r.score for r in found} == {"kept", None}
    by = {(r.doc_id, r.text): r.lang_id for r in found}
    for key in edge[:3]:
        assert (by[key[:2]].lang_pred, by[key[:2]].score, by[key[:2]].rejected) == ("und", 0.0, True)
    assert by[edge[3][:2]].lang_pred == "xa" and by[(5, "日本")].lang_pred in model.classes
    assert langid.identify(df.limit(0), model).collect() == []


def test_without_labels_everything_is_rejected(spark):
    df = spark.createDataFrame(labelled(5, 2), "doc_id long, text string, lang string")
    model = langid.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {tuple(r.lang_id) for r in langid.identify(df, model).collect()} == {("und", 0.0, True)}


def test_window_edges_do_not_change_the_sums(monkeypatch):
    rng = np.random.default_rng(2)
    table = rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    texts = [t for _, t, _ in labelled(40, 4)] + ["", "a", "é", "  "]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    whole = langid.gram_sums(data, offsets, table)
    for i, t in enumerate(texts):
        bucket, count = langid.gram_counts(t)
        assert count.sum() == whole[1][i]
        np.testing.assert_allclose((table[bucket] * count[:, None]).sum(axis=0), whole[0][i], atol=1e-3)
    for window in (5, 17, 256):
        monkeypatch.setattr(langid, "WINDOW", window)
        sums, counts = langid.gram_sums(data, offsets, table)
        assert (counts == whole[1]).all()
        np.testing.assert_allclose(sums, whole[0], atol=1e-6)


def test_a_hot_id_and_clashing_names(spark):
    words = {"en": "the cat and the dog went out", "de": "der hund und die katze gingen raus", "fr": "le chat et le chien sont sortis"}
    rows = [(1, f"{words['en']} {i}", "en", False) for i in range(300)] + [(1, words["en"], "en", True)] * 200
    rows += [(i, f"{words[x]} {i}", x, True) for i in range(2, 60) for x in ("de", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, has_letter boolean")
    df = df.withColumn("_has_letter_lang_id", F.col("doc_id"))
    models = [langid.train(d, per_class=40) for d in (df, df.repartition(7, "text"))]
    assert models[0].classes == ["de", "en", "fr"] and (models[0].weights == models[1].weights).all()
    got = langid.identify(df, models[0])
    assert got.columns == [*df.columns, "lang_id"]
    assert all(r.lang_id.lang_pred == r.lang and r["_has_letter_lang_id"] == r.doc_id for r in got.collect())


def test_texts_of_documents_alone_in_their_component_are_not_shuffled(spark):
    from newsflow.llm import simhash as S
    rows = [(i, " ".join(f"w{(i * 7919 + j * j * 31) % 10007}" for j in range(60))) for i in range(40)] + [(50, "same text of two"), (51, "same text of two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = S.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(40), 50]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "LeftAnti" in plan
