"""Line dedup on lines whose edit threshold is over two."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsflow.llm import line_dedup as L

from .test_lines_mixing import levenshtein


def edited(line, edits, rng):
    out = list(line)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at:at + rng.randint(0, 1)] = rng.choice(["", "q", "é", "xy"[:1]])
    return "".join(out)


def test_the_threshold_is_a_share_of_the_length():
    assert [L.allowed(n) for n in (9, 10, 20, 59, 60, 100, 500, 5_000)] == [0, 1, 2, 2, 3, 5, 25, 250]


def test_a_run_without_edits_holds_a_window():
    for n in range(L.LONG, 20_000):
        t = L.allowed(n)
        assert -(-(n - t) // (t + 1)) >= L.GRAM + L.WINDOW - 1
    assert L.CLASSES > 1 + 1 / L.EDIT_CHARS


@settings(max_examples=300, deadline=None)
@given(st.integers(60, 700), st.integers(0, 1 << 30), st.sampled_from(["ab", "abcdefgh ", "the "]))
def test_close_long_lines_meet_under_a_key(n, seed, letters):
    rng = random.Random(seed)
    a = "".join(rng.choice(letters) for _ in range(n))
    short, long_ = sorted([a, edited(a, rng.randint(1, L.allowed(n)), rng)], key=len)
    if levenshtein(short, long_) > L.allowed(len(short)):
        return

    def keys(line):
        got = {(s, line[at:at + m]): i for s, at, m, i in L.probes(len(line))}
        if len(line) >= L.LONG:
            got.update({(k, at): i for _, at, k, i in zip(*(x.tolist() for x in L.anchor_keys([line])))})
        return got
    ks, kl = keys(short), keys(long_)
    if len(short) < L.LONG:
        assert {k for k, i in ks.items() if i} & set(kl)
    else:
        most = L.allowed(len(short))
        assert any(i and k == other and abs(at - place) <= most for (k, at), i in ks.items() for other, place in kl
                   if isinstance(place, int))


@pytest.mark.parametrize("group, most", [(L.GROUP, L.BROADCAST_ROWS), (3, 0)])
def test_long_near_copies_are_linked(spark, monkeypatch, group, most):
    monkeypatch.setattr(L, "GROUP", group)
    monkeypatch.setattr(L.bounded, "__defaults__", (most,))
    rng = random.Random(8)
    words = ["the", "of", "de", "haus", "lumière", "market", "rain", "日本"]
    lines = []
    for n in (12, 16, 20, 40, 90, 250):
        for _ in range(3):
            base = " ".join(rng.choice(words) for _ in range(n))
            lines += [base] + [edited(base, rng.randint(1, L.allowed(len(base)) + 2), rng) for _ in range(5)]
    lines = sorted(set(lines))
    want = {frozenset((a, b)) for i, a in enumerate(lines) for b in lines[i + 1:]
            if abs(len(a) - len(b)) <= L.allowed(min(len(a), len(b)))
            and L.edit_distance(a, b, L.allowed(min(len(a), len(b)))) <= L.allowed(min(len(a), len(b)))}
    assert sum(levenshtein(*p) > 2 for p in want) > 50
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    number = {L.xxhash.xxh64_intdigest(x, 42): x for x in lines}
    got = {frozenset(number[x & (1 << 64) - 1] for x in r) for r in L.links(df).collect()}
    assert got == want
    assert L.dedup_lines(df).count() < len(lines) / 2


def test_distance_of_long_lines():
    rng = random.Random(4)
    for _ in range(60):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(60, 160)))
        b = edited(a, rng.randint(0, 14), rng)
        for most in (3, 8, 30):
            assert L.edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)


def test_rows_of_lines_within_the_distance_agree_on_what_follows():
    rng = random.Random(5)
    for _ in range(300):
        line = "".join(rng.choice("abcde fgh") for _ in range(rng.randint(80, 400)))
        other = edited(line, rng.randint(0, L.allowed(len(line))), rng)
        short, long_ = sorted((line, other), key=len)
        most = L.allowed(len(short))
        if len(short) < L.LONG or levenshtein(short, long_) > most:
            continue
        sets = []
        for text, filed in ((short, True), (long_, False)):
            n, at, key, _ = L.anchor_keys([text], filed)
            sets.append(list(zip(key.tolist(), at.tolist(), L.followers([text], n, at).tolist())))
        size = L.np.array([len(short)])
        assert any(k == m and abs(q - p) <= (before := int(L._segment_of(size, L.np.array([p]))[0]))
                   and abs(len(long_) - len(short) - q + p) <= most - before and (x ^ y).bit_count() <= 2 * (L.NEXT - 1)
                   for k, p, x in sets[0] for m, q, y in sets[1])


def test_followers_count_characters_modulo_four():
    text = "e" * 5 + "zebra" * 40
    places = L.np.array([0, 3, 150, 200])
    found = L.followers(["abc" * 30, text], L.np.ones(4, int), places).tolist()
    for at, bits in zip(places.tolist(), found):
        counts = [0] * 16
        for c in text[at:at + L._COUNTED]:
            counts[L._LANES[ord(c)]] += 1
        assert bits == sum((n % 4 ^ n % 4 >> 1) << 2 * lane for lane, n in enumerate(counts))


def test_lines_that_share_a_phrase_only_are_no_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    lines = [(" ".join(word() for _ in range(12))[:40] + " a phrase that many lines hold " + " ".join(word() for _ in range(60)))[:200]
             for _ in range(60)]
    docs = spark.createDataFrame([("\n".join(lines + [edited(lines[0], 8, rng)]),)], "text string")
    written, given = [], L.materialize
    L.materialize = lambda df, name="table": (written.append((name, out := given(df, name))), out)[1]
    try:
        found = L.links(docs).collect()
    finally:
        L.materialize = given
    assert len(found) == 1
    assert dict(written)["long-pairs"].count() <= 5     # not all that meet under the phrase
