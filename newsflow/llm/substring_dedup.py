"""Substring dedup: repeated runs of words by level-wise doubling.

A word goes if a window of ``window`` consecutive words that covers it also
starts earlier: in a document of smaller id, or earlier in its own. Matches
never cross documents, and windows are judged on the input.

Levels. The first length is ``start``; each level doubles it until it is the
window itself, or until no candidates survive. A window can only be repeated
if the shorter windows inside it are, so what is met once at one length is
never looked at again:

* at the first length every window of the text is led by one shorter window,
  the one of least hash in it (the leftmost of them). That depends on the
  window alone, so equal windows are led from the same place, and one shorter
  window leads many: about ``2 / (window - start + 2)`` names a word are counted, in
  place of one a word;
* a level counts the names (64-bit hashes) of the candidates of its length;
  only numbers are shuffled, and a name that very many places share is reduced
  map side. The repeated names go back to the tasks as a Bloom filter of at
  most ``MAX_BLOCKS`` blocks (32 MB), whatever their number: past that it lets
  more pass, which costs rows of the next level and loses nothing;
* candidates that pass are extended to twice the length, to the right where
  the window has room and else to the left, always around the shorter one;
* at the last length the windows themselves meet, packed by their leader, and
  are told apart by the leader's and their own 64-bit hash together. Of equal
  windows the first place stays and the others are marked.

Hot leaders (the ``HOT`` most frequent ones with more than ``GROUP`` places)
are dealt over blocks by document; every block keeps its first place, and the
first of those is found by a partial aggregate. Documents are read again at
each level, and their texts are shuffled once, to meet their marks.

Order and defined results: documents are ordered by id (an integer), those
without an id come last, and documents of one id by a hash of their text; rows
repeated as a whole are cut alike. A NULL or empty text has no words, and one
with fewer words than the window loses none; texts are worked on ``PIECE``
words at a time, short ones together; an empty table gives no rows. Other columns pass through,
but for those named like the three that are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import bloom
from .common import fresh, key_runs, utf8_of, worker_cache
from .words import SPACE, word_chunks

WINDOW = 20
START = 5
PIECE = 1 << 18          # windows worked on at once
MAX_BLOCKS = 1 << 22
GROUP = 20_000           # places of a leader compared in one task
HOT = 100_000            # leaders that may be dealt over blocks
BYTES = 1 << 20          # of texts hashed at once
OUT_ROWS = 1 << 16

_ODD = np.uint64(0x9E3779B97F4A7C15)


# --------------------------------------------------------------------- names
_RANDOM = np.random.default_rng(13)
_TABLE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(1 << 62, 1 << 63)) | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2 ** 64."""
    kept = worker_cache("substrings")
    if len(kept.get("powers", ((), ()))[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        kept["powers"] = tuple(np.r_[np.uint64(1), np.multiply.accumulate(np.full(size - 1, b, np.uint64))]
                               for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return kept["powers"]


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of texts that lie end to end, words of each
    text): a polynomial over the bytes of a word, from prefix sums over all
    of them, brought back to its first byte."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]      # words end where texts do
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:len(data)], out=sums[1:])
    words = bloom.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)
    return words, np.diff(np.searchsorted(start, offsets))


def _long_text(data: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        cut = SPACE.search(data, at + BYTES)
        end = cut.start() if cut else len(data)
        parts.append(hash_words(np.frombuffer(data, np.uint8)[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(parts)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return bloom.mix(left * _ODD + (right ^ (right >> np.uint64(31))))


def first_names(words: np.ndarray, length: int) -> np.ndarray:
    """Names of the runs of ``length`` words at every place."""
    names, size = bloom.mix(words + _ODD), 1
    while size < length:
        step = min(size, length - size)
        names = _pair(names[:len(names) - step], names[step:])
        size += step
    return names


def leaders(names: np.ndarray, span: int) -> np.ndarray:
    """For every window, the place of the least of its ``span`` names, the
    leftmost of equals."""
    low = np.uint64((1 << 20) - 1)
    least, size = (names & ~low) | np.arange(len(names), dtype=np.uint64), 1
    while size < span:
        step = min(size, span - size)
        least = np.minimum(least[:len(least) - step], least[step:])
        size += step
    return (least & low).astype(np.int64)


def survivors(words: np.ndarray, mine: np.ndarray, window: int, start: int, filters: dict[int, np.ndarray], length: int):
    """Of the windows ``mine`` of a block those that are candidates at
    ``length``: (window, place and name of its run of that length, name of its
    leader). ``filters`` are the repeated names of the lengths before."""
    names, size = first_names(words, start), start
    at = leaders(names, window - start + 1)[mine]
    lead = names[at]
    while True:
        if size in filters:
            passed = bloom.contains(filters[size], names[at])
            mine, at, lead = mine[passed], at[passed], lead[passed]
        if size == length:
            return mine, at, names[at], lead
        names = _pair(names[:len(names) - size], names[size:])
        size *= 2
        if size == window:
            at = mine
        else:       # to the right where there is room, else to the left
            at = np.where(at + size <= mine + window, at, np.maximum(at - size // 2, mine))


def blocks(column: pa.Array, window: int, piece: int):
    """Texts laid end to end, some megabytes and then ``piece`` words at a
    time: (words, windows inside a text, row of the text and number of the
    window in it)."""
    data, offsets = utf8_of(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BYTES, side="right")) - 1)
        some = data[offsets[i]:offsets[j]]
        if len(some) > BYTES:
            words = _long_text(some.tobytes())
            sizes = np.array([len(words)])
        else:
            words, sizes = hash_words(some, offsets[i:j + 1] - offsets[i])
        begin, count = np.cumsum(sizes) - sizes, np.maximum(sizes - window + 1, 0)
        text = np.repeat(np.arange(len(sizes)), count)
        number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        mine = begin[text] + number
        for lo in range(0, len(words) - window + 1, piece):
            own = slice(*np.searchsorted(mine, (lo, lo + piece)))
            if own.start < own.stop:
                yield words[lo:lo + piece + window - 1], mine[own] - lo, text[own] + i, number[own]
        i = j


def _count(shared, window: int, start: int, length: int, piece: int):
    """(text) to the names of its candidates at ``length``, one for each place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, mine, _, _ in blocks(batch.column(0), window, piece):
                _, at, names, _ = survivors(words, mine, window, start, shared.value, length)
                names = names[np.unique(at, return_index=True)[1]]
                for lo in range(0, len(names), OUT_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(names[lo:lo + OUT_ROWS].view(np.int64))], names=["h"])
    return run


def _windows(shared, window: int, start: int, piece: int):
    """(no_id, id, tie, text) to the candidate windows of full length, in runs
    that one leader leads: (deal, leader, no_id, id, tie, first, names).
    leader is given for hot ones alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, hot, parts = shared.value
        for batch in batches:
            for words, mine, row, number in blocks(batch.column(3), window, piece):
                left, _, names, lead = survivors(words, mine, window, start, filters, window)
                if not len(left):
                    continue
                # where in ``mine`` the candidates are: both are sorted
                at = np.searchsorted(mine, left)
                cut = np.flatnonzero(np.r_[True, (left[1:] != left[:-1] + 1) | (lead[1:] != lead[:-1])])
                ends = np.r_[cut, len(left)]
                for lo in range(0, len(cut), OUT_ROWS):
                    some = cut[lo:lo + OUT_ROWS]
                    yield _window_rows(batch, row[at[some]], number[at[some]], lead[some],
                                       ends[lo:lo + len(some) + 1], names, hot, parts)
    return run


def _window_rows(batch, row, first, lead, ends, names, hot, parts) -> pa.RecordBatch:
    ids = [batch.column(c).take(pa.array(row)) for c in range(3)]
    deal, dealt = lead, np.zeros(len(lead), bool)
    if len(hot):
        place = np.minimum(np.searchsorted(hot, lead), len(hot) - 1)
        dealt = hot[place] == lead
        by = bloom.mix(ids[1].to_numpy().view(np.uint64) * _ODD ^ ids[2].to_numpy().view(np.uint64))
        deal = np.where(dealt, bloom.mix(lead + _ODD * (1 + by % parts[place])), lead)
    packed = pa.Array.from_buffers(pa.binary(), len(row), [
        None, pa.py_buffer(((ends - ends[0]) * 8).astype(np.int32).tobytes()),
        pa.py_buffer(names[ends[0]:ends[-1]].tobytes())])
    return pa.RecordBatch.from_arrays(
        [pa.array(deal.view(np.int64)), pa.array(lead.view(np.int64), mask=~dealt), *ids,
         pa.array(first.astype(np.int32)), packed],
        names=["deal", "leader", "no_id", "id", "tie", "first", "names"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole runs of ``deal`` to (no_id, id, tie, first, n, leader, name): runs
    of n windows that also start earlier and, of dealt leaders, the first
    place of every window (n = 0)."""
    for batch in key_runs(batches):
        column = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4, 5)]
        packed = batch.column(6)
        ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1].astype(np.int64)
        names = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(np.int64)
        sizes = np.diff(ends) // 8
        row = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        deal, no_id, key, tie = (c[row] for c in column[:4])
        place = column[4][row] + within
        order = np.lexsort((place, tie, key, no_id, names, deal))
        sort = lambda x: x[order]
        new = np.r_[True, (sort(deal)[1:] != sort(deal)[:-1]) | (sort(names)[1:] != sort(names)[:-1])]
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        later = np.zeros(len(row), bool)
        later[order] = ((sort(place) != place[lead]) | (sort(key) != key[lead]) | (sort(tie) != tie[lead])
                        | (sort(no_id) != no_id[lead]))
        begin = np.flatnonzero(later & np.r_[True, ~later[:-1] | (row[1:] != row[:-1])])
        end = np.flatnonzero(later & np.r_[~later[1:] | (row[1:] != row[:-1]), True])
        if len(begin):
            yield _marks(batch, row[begin], place[begin], end - begin + 1, None, None)
        hot = np.sort(order[new])
        hot = hot[batch.column(1).is_valid().to_numpy(zero_copy_only=False)[row[hot]]]
        if len(hot):
            yield _marks(batch, row[hot], place[hot], np.zeros(len(hot)), batch.column(1).take(pa.array(row[hot])), names[hot])


def _marks(batch, row, place, n, leader, name) -> pa.RecordBatch:
    none = pa.nulls(len(row), pa.int64())
    return pa.RecordBatch.from_arrays(
        [*[batch.column(c).take(pa.array(row)) for c in (2, 3, 4)], pa.array(place.astype(np.int32)),
         pa.array(n.astype(np.int32)), none if leader is None else leader, none if name is None else pa.array(name)],
        names=["no_id", "id", "tie", "first", "n", "leader", "name"])


# --------------------------------------------------------------------- texts
def _cut(window: int, text_at: int, runs_at: int, schema: pa.Schema):
    """Adds (n_words, spans, kept) to a text with its marked windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(runs_at)
            counts, spans, kept = [], [], []
            for i in range(batch.num_rows):
                text = batch.column(text_at)[i].as_py()
                if text is None:
                    counts.append(0), spans.append([]), kept.append(None)
                    continue
                cuts = _merged(marks[i].as_py() or [], window)
                n, left, at = 0, [], 0
                for words in word_chunks(text.encode()):
                    lo = n
                    n += len(words)
                    place = lo
                    while at < len(cuts) and cuts[at][0] < n:
                        left += words[place - lo:max(cuts[at][0], lo) - lo]
                        place = min(cuts[at][1], n)
                        if cuts[at][1] > n:
                            break
                        at += 1
                    left += words[place - lo:]
                counts.append(n), spans.append(cuts), kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:runs_at], pa.array(counts, pa.int64()),
                 pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], schema.field("spans").type),
                 pa.array(kept, pa.string())], names=[*batch.schema.names[:runs_at], *schema.names])
    return run


def _merged(marks: list[dict], window: int) -> list[tuple[int, int]]:
    """Marked runs of windows as maximal runs of words."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((m["first"], m["first"] + m["n"] - 1 + window) for m in marks):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def repeated_windows(docs: DataFrame, text_col: str, id_col: str, window: int = WINDOW, start: int = START) -> DataFrame:
    """(no_id, id, tie, first, n): n windows from word ``first`` on that also
    start earlier; tie is a hash of the text."""
    if window < start or window % start or (window // start).bit_count() != 1:
        raise ValueError("the window must be the first length, doubled some times")
    spark = docs.sparkSession
    rows = docs.where(F.length(text_col) > 0).select(
        F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    empty = "no_id boolean, id long, tie long, first int, n int"
    filters: dict[int, np.ndarray] = {}
    hot, parts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    length = start
    while length < window:
        counted = rows.select("text").mapInArrow(_count(spark.sparkContext.broadcast(filters), window, start, length, PIECE), "h long")
        repeated = materialize(counted.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"repeated-{length}")
        n = repeated.count()
        if not n:       # no candidates survive
            return spark.createDataFrame([], empty)
        if length == start:     # of the first length: these names lead the windows
            many = repeated.where(F.col("n") > GROUP).orderBy(F.desc("n")).limit(HOT).toArrow()
            keys = many.column("h").to_numpy().view(np.uint64)
            order = np.argsort(keys)
            hot, parts = keys[order], (many.column("n").to_numpy()[order] // GROUP + 1).astype(np.uint64)
        filters = {length: bloom.fill(repeated.select(F.lit(0).alias("shard"), "h"), bloom.sizes({0: n}, MAX_BLOCKS))[0]}
        length *= 2
    shared = spark.sparkContext.broadcast((filters, hot, parts))
    dealt = rows.mapInArrow(_windows(shared, window, start, PIECE),
                            "deal long, leader long, no_id boolean, id long, tie long, first int, names binary")
    marks = (dealt.repartition("deal").sortWithinPartitions("deal")
             .mapInArrow(_later, "no_id boolean, id long, tie long, first int, n int, leader long, name long"))
    if not len(hot):
        return marks.select("no_id", "id", "tie", "first", "n")
    marks = materialize(marks, "marks")
    found = marks.where("n > 0").select("no_id", "id", "tie", "first", "n")
    firsts = marks.where("n = 0").select("leader", "name", F.struct("no_id", "id", "tie", "first").alias("at"))
    least = firsts.groupBy("leader", "name").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("several")).where("several > 1")
    later = firsts.join(least, ["leader", "name"]).where("at <> least").select("at.*", F.lit(1).alias("n"))
    return found.unionByName(later)


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW,
                   start: int = START) -> DataFrame:
    """``docs`` with n_words, spans (removed runs of words: start, end) and
    kept (the other words, joined by one space; NULL for a NULL text)."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "spans", "kept")])
    marks = repeated_windows(docs, text_col, id_col, window, start)
    by_doc = marks.groupBy("no_id", "id", "tie").agg(F.collect_set(F.struct("first", "n")).alias("marks"))
    no_id, key, tie, runs = fresh(docs, "no_id", "id", "tie", "marks")
    by_doc = by_doc.select(F.col("no_id").alias(no_id), F.col("id").alias(key), F.col("tie").alias(tie), F.col("marks").alias(runs))
    keyed = docs.withColumns({no_id: F.col(id_col).isNull(), key: F.coalesce(F.col(id_col).cast("long"), F.lit(0)),
                              tie: F.xxhash64(text_col)})
    joined = keyed.join(by_doc, [no_id, key, tie], "left").select(*[F.col(f"`{c}`") for c in docs.columns], runs)
    added = T.StructType([T.StructField("n_words", T.LongType()),
                          T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()),
                                                                           T.StructField("end", T.IntegerType())]))),
                          T.StructField("kept", T.StringType())])
    arrow = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                       ("kept", pa.string())])
    return joined.mapInArrow(_cut(window, docs.columns.index(text_col), len(docs.columns), arrow),
                             T.StructType([*docs.schema.fields, *added.fields]))
