"""Spelling variant grouping by Bloom-guided neighbourhoods.

Two words are near if exactly one inserted, deleted or replaced code point
turns one into the other. Instead of comparing words with words, the edits of
every word are generated and looked up:

* counting: tasks count the words of their texts and give out (word, n)
  partial counts, so frequent words are reduced map side;
* filters: the vocabulary is sharded by word length, and every shard has a
  blocked Bloom filter, four bits of one block to a word. It grows with the
  vocabulary up to ``MAX_BLOCKS`` blocks in all (16 MB), which bounds the
  broadcast. Beyond it the filters let more pass,
  which costs shuffled rows and loses nothing;
* probes: a word's deletions are looked up in the shard of the next shorter
  words, its replacements by a larger code point in its own. Insertions are
  the deletions of the longer word and smaller code points are the
  replacements of the other word, so each pair is generated once. The hash is
  a polynomial over code points: an edit's hash comes from those of the parts
  left and right of it, for all edits of a batch at once;
* exact join: only what passes goes, as text, to a join with the vocabulary
  on the word itself, which removes the false positives.

A word has at most about 90 neighbours per code point, so no group grows with
the data. A word's form is its near word of the largest count when that is at
least twice its own; counts double along forms, so chains are short, and
roots are found by pointer doubling.

Words have code points below U+0100 only (``LETTERS``). Defined results: a
NULL text has no words; a NULL id is written as nothing in the hashed name of
a run; rows repeated as a whole count each; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import bloom
from .common import worker_cache

LETTERS = "A-Za-zÀ-ÿ"
MIN_POINTS = 5
MIN_COUNT = 3
TYPO_EVERY = 97          # runs whose hash this divides lose a code point
SHARDS = 64              # words of this length or more share a shard
MAX_BLOCKS = 1 << 21     # of 64 bits, over all shards
PROBES = 1 << 20         # edits looked up at once
PIECE = 1 << 22          # code points of a text worked on at once
HELD = 200_000           # different words a task counts before it gives them out
ROWS_OUT = 1 << 16       # pairs of an output batch
BASE = 0x9E3779B97F4A7C15


# ------------------------------------------------------------------ counting
_RUN = re.compile(f"[{LETTERS}]+")
_OTHER = re.compile(f"[^{LETTERS}]")


def run_counts(text: str, piece: int = PIECE) -> Counter:
    """Counts of the runs of letters of a text, A-Z lower-cased."""
    text = text.encode().lower().decode()     # bytes.lower() leaves all but A-Z alone
    out, at = Counter(), 0
    while at < len(text):
        cut = _OTHER.search(text, at + piece)
        end = cut.start() if cut else len(text)
        out.update(_RUN.findall(text, at, end))
        at = end
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to partial counts (word, n) of words that are long enough."""
    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    worker_cache("spelling")
    held: dict[str, int] = {}
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            start = zlib.crc32(b"" if key is None else str(key).encode())
            start = zlib.crc32(b":", start)
            for run, n in run_counts(text).items():
                h = zlib.crc32(run.encode(), start)
                if h % TYPO_EVERY == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                if len(run) >= MIN_POINTS:
                    held[run] = held.get(run, 0) + n
            if len(held) >= HELD:
                yield out()
                held = {}
    if held:
        yield out()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    counts = docs.select(id_col, text_col).mapInArrow(_count_words, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# ------------------------------------------------------------------- filters
def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.multiply.accumulate(np.full(n - 1, BASE, np.uint64))
    return out


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(length, places in ``words``, matrix of code points), a few rows of
    long words at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == n).tolist()
        step = max(1, PROBES // (n * 64))
        for lo in range(0, len(places), step):
            some = places[lo:lo + step]
            raw = "".join([words[i] for i in some]).encode("latin-1")
            yield n, some, np.frombuffer(raw, np.uint8).reshape(len(some), n).astype(np.uint64)


def _shard(length: int) -> int:
    return min(length, SHARDS)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word) to (shard, h)."""
    for batch in batches:
        for n, _, points in _by_length(batch.column(0).to_pylist()):
            h = bloom.mix((points * _powers(n)).sum(axis=1, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), _shard(n), np.int32)), pa.array(h.view(np.int64))],
                                             names=["shard", "h"])


def bloom_filters(words: DataFrame) -> dict[int, np.ndarray]:
    """Shard to blocks. The driver holds MAX_BLOCKS blocks and one more per
    shard at most."""
    shard = F.least(F.length("word"), F.lit(SHARDS))
    counts = {r.shard: r.n for r in words.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return bloom.fill(words.select("word").mapInArrow(_hash, "shard int, h long"), bloom.sizes(counts, MAX_BLOCKS))


# -------------------------------------------------------------------- probes
def _passes(h: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return bloom.contains(blocks, bloom.mix(h))


def edits(words: list[str], filters: dict[int, np.ndarray], letters: np.ndarray) -> Iterator[tuple[list[int], list[str]]]:
    """(place of a word, edit) for the deletions and the replacements by a
    larger letter that pass the filters, a bounded number at a time."""
    for n, places, points in _by_length(words):
        power = _powers(n)
        terms = points * power
        if n > 1 and _shard(n - 1) in filters:
            # left part as it is; the right part moves one place to the left
            left = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
            moved = np.zeros_like(terms)
            moved[:, 1:] = points[:, 1:] * power[:-1]
            right = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1] - moved
            # of a run of equal letters only the first is deleted
            own = np.ones(points.shape, bool)
            own[:, 1:] = points[:, 1:] != points[:, :-1]
            row, at = np.nonzero(own & _passes(left + right, filters[_shard(n - 1)]))
            row, at = row.tolist(), at.tolist()
            yield [places[r] for r in row], [words[places[r]][:i] + words[places[r]][i + 1:] for r, i in zip(row, at)]
        if _shard(n) not in filters:
            continue
        whole = terms.sum(axis=1, dtype=np.uint64)
        width = max(1, PROBES // (len(places) * len(letters)))
        for lo in range(0, n, width):
            here = points[:, lo:lo + width]
            change = (letters[None, None, :] - here[:, :, None]) * power[None, lo:lo + width, None]
            row, at, to = np.nonzero((letters[None, None, :] > here[:, :, None])
                                     & _passes(whole[:, None, None] + change, filters[_shard(n)]))
            row, at, to = row.tolist(), (at + lo).tolist(), letters[to].tolist()
            yield ([places[r] for r in row],
                   [words[places[r]][:i] + chr(c) + words[places[r]][i + 1:] for r, i, c in zip(row, at, to)])


def _probe(shared, letters: list[int]):
    """(word, n) to (word, n, other) with other an edit that passes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = np.array(letters, np.uint64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            at: list[int] = []
            other: list[str] = []
            for places, found in edits(words, shared.value, alphabet):
                at += places
                other += found
                if len(at) >= ROWS_OUT:
                    yield _rows(batch, at, other)
                    at, other = [], []
            if at:
                yield _rows(batch, at, other)
    return run


def _rows(batch: pa.RecordBatch, at: list[int], other: list[str]) -> pa.RecordBatch:
    some = pa.array(at, pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(some), batch.column(1).take(some), pa.array(other, pa.string())], names=["word", "n", "other"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every two near words of ``words`` (word, n),
    once."""
    spark = words.sparkSession
    letters = sorted(ord(r.c) for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect() if r.c)
    shared = spark.sparkContext.broadcast(bloom_filters(words))
    passed = words.select("word", "n").mapInArrow(_probe(shared, letters), "word string, n long, other string")
    return passed.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select(
        "word", "n", "other", "other_n")


# --------------------------------------------------------------------- forms
def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): pointer doubling, one small job and one
    written table for each doubling of the longest chain."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialize(now.join(further, "root", "left").select("word", "root", "next"), "roots")
        if not jumped.where(F.col("next").isNotNull()).take(1):
            return now
        now = jumped.select("word", F.coalesce("next", "root").alias("root"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary."""
    words = materialize(vocabulary(docs, id_col, text_col), "vocabulary")
    pairs = materialize(near_pairs(words), "near-pairs")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"),
                                          F.col("word").alias("other"), F.col("n").alias("other_n")))
    by_word = Window.partitionBy("word")
    best = (both.withColumn("place", F.row_number().over(by_word.orderBy(F.desc("other_n"), F.asc("other"))))
            .withColumn("n_near", F.count(F.lit(1)).over(by_word)).where("place = 1"))
    formed = F.col("other_n") >= 2 * F.col("n")
    best = materialize(best.select("word", "n_near", F.when(formed, F.col("other")).alias("form"),
                                   F.when(formed, F.col("other_n")).alias("form_n")), "forms")
    chains = roots(best.where(F.col("form").isNotNull()))
    return (words.join(best, "word", "left").join(chains, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
