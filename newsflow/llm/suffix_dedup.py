"""Exact removal of repeated passages by a distributed difference-cover
suffix sort.

A byte goes if some ``length``-byte string that covers it also starts at
another place, in the same document or another. Matches never cross
documents; strings are judged on the input.

1. Anchors. Every string of ``length`` bytes has one anchor: the start of the
   ``gram``-byte piece with the least hash in it (the leftmost of them). It
   depends on the string alone, so equal strings have their anchors at the
   same place. A document becomes the sequence of its anchors, about one in
   ``(length - gram) / 2`` bytes; a symbol is the text from one anchor to the
   next. A piece met at one anchor only cannot lie in a repeated string, so
   such anchors end the sequences.
2. Suffix sort of the anchor sequences (``suffix_ranks``), by the
   difference-cover scheme modulo 3: the triples at positions not divisible
   by 3 are sorted and named; while a name that occurs twice stands for less
   than is needed, the sequences of names are sorted by recursion (here to
   names of ``3 ** LEVELS`` symbols, some 1,400 bytes); then the
   remaining suffixes are merged in by (symbol, rank of the next position)
   against the suffixes at 1 mod 3 and by (two symbols, rank after them)
   against those at 2 mod 3. Merging is counting: the rank of a suffix is the
   number of smaller ones, summed over the three residues, from prefix sums
   over the sorted different keys, so keys that very many suffixes share cost
   one row each.
3. Adjacent prefixes. Suffixes of one rank are ordered by the hash of their
   prefix, and neighbours in suffix order are compared on the next
   ``2 * (length - gram + 1) + length`` bytes (to the end of a symbol). Where
   they agree, every string whose anchor lies well inside is repeated.
4. Exact check of what is left: the strings of anchors near the ends of such
   agreements, or in shorter ones. Their surroundings are grouped by piece,
   together with one of each kind of agreeing surroundings, and all their
   strings are compared by two 64-bit hashes. Pieces with more than
   ``GROUP`` surroundings are compared by grouping their strings over all
   tasks.

Equal texts are collapsed before step 2: a text of ``length`` bytes or more
that occurs twice goes as a whole. Texts travel to other tasks only for
documents that have something to check or to remove.

Equality of symbols, pieces, prefixes and strings is equality of 64-bit
hashes or pairs of them; where one hash decides alone it is joined by the
piece's hash (128 bits together).

Defined results: a NULL or empty text, or one shorter than ``length``, has no
spans (kept is empty for NULL); rows repeated as a whole count as two places;
other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import fresh, key_runs, stored, worker_cache
from .line_dedup import bounded

LENGTH = 400
GRAM = 128
PIECE = 1 << 19          # strings of a document worked on at a time
LEVELS = 2               # names of 9 symbols; what they leave tied is ordered by its prefix
GROUP = 4000             # surroundings of a piece compared in one task
WINDOWS = 1 << 20        # strings hashed at a time
OUT_ROWS = 50_000

_RANDOM = np.random.default_rng(20)
_TABLES = _RANDOM.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = [int(x) | 1 for x in _RANDOM.integers(1 << 62, 1 << 63, 2)]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


# ------------------------------------------------------------------- anchors
def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes at every position, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _ODD
    size = 1
    while size < gram:
        step = min(size, gram - size)
        left, right = h[:len(h) - step], h[step:]
        h = (left * _MIX) ^ (right + (left >> np.uint64(29)))
        size += step
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first string, last string, piece hash) of every anchor: the
    strings that start from first to last have it."""
    span, n = length - gram + 1, len(data) - length + 1
    low = np.uint64((1 << 20) - 1)
    places, firsts, pieces = [], [], []
    for lo in range(0, n, PIECE):
        h = gram_hashes(data[lo:min(lo + PIECE, n) + length - 1], gram)
        # high bits decide, equal ones leave it to the position: leftmost
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size < span:
            step = min(size, span - size)
            least = np.minimum(least[:len(least) - step], least[step:])
            size += step
        at = (least & low).astype(np.int64)
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        if places and places[-1][-1] == at[0] + lo:
            new = new[1:]
        places.append(at[new] + lo)
        firsts.append(new + lo)
        pieces.append(h[at[new]])
        if not len(new):
            places.pop(), firsts.pop(), pieces.pop()
    place, first = np.concatenate(places), np.concatenate(firsts)
    return place, first, np.r_[first[1:] - 1, n - 1], np.concatenate(pieces)


_ANCHOR = pa.schema([("sid", pa.int64()), ("t1", pa.int64()), ("t2", pa.int32()), ("n", pa.int32()), ("at", pa.int32()),
                     ("pos", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("until", pa.int32()), ("size", pa.int32()),
                     ("piece", pa.int64()), ("symbol", pa.int64()), ("prefix", pa.int64())])


def _anchor_rows(length: int, gram: int):
    digest = xxhash.xxh64_intdigest
    reach = 2 * (length - gram + 1) + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("suffix")
        sid = TaskContext.get().partitionId() << 36
        held, rows = [], 0
        for batch in batches:
            texts, t1, t2 = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i in range(len(texts)):
                raw = texts[i].as_py().encode()
                if len(raw) < length:
                    continue
                pos, lo, hi, piece = anchors(np.frombuffer(raw, np.uint8), length, gram)
                ends = np.r_[pos[1:], len(raw)]
                until = np.r_[pos, len(raw)][np.searchsorted(pos, pos + reach)]
                cut = pos.tolist()
                symbol = np.array([digest(raw[a:b]) for a, b in zip(cut, ends.tolist())], np.uint64)
                prefix = np.array([digest(raw[a:b]) for a, b in zip(cut, until.tolist())], np.uint64)
                m = len(pos)
                held.append((np.full(m, sid), np.full(m, t1[i]), np.full(m, t2[i]), np.full(m, len(raw)), np.arange(m), pos, lo, hi,
                             until, ends - pos, piece.view(np.int64), symbol.view(np.int64), prefix.view(np.int64)))
                sid, rows = sid + 1, rows + m
                if rows >= OUT_ROWS:
                    yield _gathered(held, _ANCHOR)
                    held, rows = [], 0
        if held:
            yield _gathered(held, _ANCHOR)
    return run


def _gathered(parts: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(f.type.to_pandas_dtype()))
                                       for c, f in zip(zip(*parts), schema)], schema=schema)


# --------------------------------------------------------------- suffix sort
def _prefix_counts(keys: DataFrame, order: list[str], counts: list[str]) -> DataFrame:
    """Adds to different keys with counts ``less_<count>``, the sum over
    smaller keys. Keys are dealt by range; the totals of the parts (a row
    each) are accumulated and added to the running sums inside them."""
    dealt = stored(keys.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "keys")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(c) for c in counts]).select(
        "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in counts])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    less = [(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{c}")).alias(f"less_{c}") for c in counts]
    return dealt.join(F.broadcast(totals), "_part").select(*keys.columns, *less)


def _named(rows: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """Different keys in order: name (from 1), less_n (rows with smaller
    keys), n, and the bytes they stand for."""
    different = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("bytes"), F.max(F.lit(1).cast("long")).alias("one"))
    return _prefix_counts(different, keys, ["n", "one"]).select(*keys, "n", "less_n", "bytes", (F.col("less_one") + 1).alias("name"))


def suffix_ranks(rows: DataFrame, reach: int, levels: int | None = None) -> DataFrame:
    """(s, i, rank) for strings given as rows (s, i, c, size): symbol c > 0 at
    position i of string s stands for ``size`` bytes. rank: number of smaller
    suffixes; suffixes that agree to their ends, over ``reach`` bytes or, if
    ``levels`` is given, over 3 ** levels symbols may share one."""
    in_order = Window.partitionBy("s").orderBy("i")
    nxt = lambda c, k: F.lead(c, k, 0).over(in_order)
    third = F.pmod("i", F.lit(3))
    rows = rows.select("s", "i", "c", "size", nxt("c", 1).alias("c1"), nxt("c", 2).alias("c2"),
                       (F.col("size") + nxt("size", 1) + nxt("size", 2)).alias("wide"),
                       F.when(third > 0, F.xxhash64("s", third)).alias("s3"), F.floor(F.col("i") / 3).alias("i3"), third.alias("r3"))
    rows = stored(rows, "triples")

    # sort the sampled triples and name them
    sampled = rows.where("r3 > 0")
    names = _named(sampled, ["c", "c1", "c2"], F.col("wide"))
    named = sampled.join(names, ["c", "c1", "c2"])
    open_ = (F.col("n") > 1) & (F.col("c2") > 0) & (F.col("bytes") < reach)
    if levels != 1 and names.where(open_).limit(1).count():
        deeper = stored(named.select(F.col("s3").alias("s"), F.col("i3").alias("i"), F.col("name").alias("c"),
                                          F.col("wide").alias("size")), "names-string")
        ranks = suffix_ranks(deeper, reach, levels and levels - 1)  # recurse on the names
    else:
        ranks = named.select(F.col("s3").alias("s"), F.col("i3").alias("i"), F.col("less_n").alias("rank"))
    ranks = ranks.select(F.col("s").alias("s3"), F.col("i").alias("i3"), F.col("rank").alias("r"))
    rest = rows.where("r3 = 0").withColumn("r", F.lit(None).cast("long"))
    known = rows.where("r3 > 0").join(ranks, ["s3", "i3"]).select(*rest.columns).unionByName(rest)
    known = stored(known.select("s", "i", "c", "c1", "r3", "r", F.lead("r", 1, -1).over(in_order).alias("r1"),
                                     F.lead("r", 2, -1).over(in_order).alias("r2")), "ranked-sample")

    # merge the remaining suffixes by counting
    of = lambda k: F.sum((F.col("r3") == k).cast("long")).alias(f"n{k}")
    a = _prefix_counts(known.where("r3 <> 2").groupBy("c", "r1").agg(of(0), of(1)), ["c", "r1"], ["n0", "n1"]) \
        .select("c", "r1", F.col("less_n0").alias("a0"), F.col("less_n1").alias("a1"))
    b = _prefix_counts(known.where("r3 <> 1").groupBy("c", "c1", "r2").agg(of(0), of(2)), ["c", "c1", "r2"], ["n0", "n2"]) \
        .select("c", "c1", "r2", F.col("less_n0").alias("b0"), F.col("less_n2").alias("b2"))
    return (known.where("r3 = 0").join(a, ["c", "r1"]).join(b, ["c", "c1", "r2"])
              .select("s", "i", (F.col("a0") + F.col("a1") + F.col("b2")).alias("rank"))
              .unionByName(known.where("r3 = 1").join(a, ["c", "r1"]).select("s", "i", (F.col("r") + F.col("a0")).alias("rank")))
              .unionByName(known.where("r3 = 2").join(b, ["c", "c1", "r2"]).select("s", "i", (F.col("r") + F.col("b0")).alias("rank"))))


def _agreeing(shared: DataFrame, reach: int) -> DataFrame:
    """(sid, pos, until, prefix) of the anchors whose suffix agrees with a
    neighbour in suffix order up to ``until``."""
    symbols = _named(shared, ["piece", "symbol"], F.col("size"))
    w = Window.partitionBy("sid").orderBy("at")
    strings = shared.withColumn("_row", F.row_number().over(w)).select(
        "sid", "pos", "until", "prefix", "piece", "symbol", "size", F.xxhash64("sid", F.col("at") - F.col("_row")).alias("s"), "_row")
    strings = strings.withColumn("i", (F.row_number().over(Window.partitionBy("s").orderBy("_row")) - 1).cast("long"))
    strings = stored(strings.join(symbols.select("piece", "symbol", "name"), ["piece", "symbol"])
                          .select("sid", "pos", "until", "prefix", "piece", "s", "i", F.col("name").alias("c"),
                                  F.col("size").cast("long").alias("size")), "strings")
    ranks = suffix_ranks(strings.select("s", "i", "c", "size"), reach, LEVELS)
    order = ["rank", "prefix", "_salt"]  # the salt lets equal suffixes fall into several parts
    dealt = strings.join(ranks, ["s", "i"]).withColumn("_salt", F.xxhash64("sid", "pos")) \
        .withColumn("own", F.struct("piece", "prefix"))
    dealt = stored(dealt.select("sid", "pos", "until", "prefix", "own", "rank", "_salt").repartitionByRange(*order)
                        .withColumn("_part", F.spark_partition_id()), "suffix-array")
    inside, parts = Window.partitionBy("_part").orderBy(*order), Window.orderBy("_part")
    edges = dealt.groupBy("_part").agg(F.min_by("own", F.struct(*order)).alias("_first"), F.max_by("own", F.struct(*order)).alias("_last")) \
        .select("_part", F.lag("_last").over(parts).alias("_before"), F.lead("_first").over(parts).alias("_after"))
    compared = dealt.join(F.broadcast(edges), "_part")  # one row per part
    above = F.coalesce(F.lag("own").over(inside), F.col("_before"))
    below = F.coalesce(F.lead("own").over(inside), F.col("_after"))
    compared = compared.withColumn("_same", F.coalesce(F.col("own") == above, F.lit(False)) | F.coalesce(F.col("own") == below, F.lit(False)))
    return compared.where("_same").select("sid", "pos", "until", "prefix")


# --------------------------------------------------------------- exact check
def string_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """Two 64-bit hashes of the strings at ``starts``, from prefix sums."""
    out = []
    for table, base in zip(_TABLES, _BASES):
        power = np.full(len(data) + 1, base, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        back = np.full(len(data) + 1, pow(base, -1, 1 << 64), np.uint64)
        back[0] = 1
        back = np.cumprod(back, dtype=np.uint64)
        upto = np.r_[np.uint64(0), np.cumsum(table[data] * power[:-1], dtype=np.uint64)]
        out.append((upto[starts + length] - upto[starts]) * back[starts])
    return out


def _strings_of(batch: pa.RecordBatch, lo: int, hi: int, length: int):
    """(row, start in its document, hashes) of all strings of some rows."""
    first, last = (batch.column(c).to_numpy()[lo:hi].astype(np.int64) for c in ("lo", "hi"))
    texts = batch.column("context").slice(lo, hi - lo)
    data = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    sizes, counts = last - first + length, last - first + 1
    row = np.repeat(np.arange(hi - lo), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row + lo, first[row] + nth, string_hashes(data, np.repeat(np.cumsum(sizes) - sizes, counts) + nth, length)


_SPAN = pa.schema([("sid", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _spans(sid: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of consecutive starts as covered spans."""
    order = np.lexsort((start, sid))
    sid, start = sid[order], start[order]
    new = np.flatnonzero(np.r_[True, (sid[1:] != sid[:-1]) | (start[1:] != start[:-1] + 1)])
    return _gathered([(sid[new], start[new], start[np.r_[new[1:], len(start)] - 1] + length)], _SPAN)


def _check(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in key_runs(batches):
            piece, sid, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "sid", "kind"))
            counts = batch.column("hi").to_numpy() - batch.column("lo").to_numpy() + 1
            runs = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1], True])
            weight = np.r_[0, np.cumsum(counts)][runs]
            at = 0
            while at < len(runs) - 1:
                end = max(at + 1, int(np.searchsorted(weight, weight[at] + WINDOWS, side="right")) - 1)
                row, start, (h1, h2) = _strings_of(batch, int(runs[at]), int(runs[end]), length)
                order = np.lexsort((h2, h1))
                same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
                twice = np.zeros(len(row), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                twice &= kind[row] == 0
                if twice.any():
                    yield _spans(sid[row[twice]], start[twice], length)
                at = end
    return run


def _string_rows(length: int):
    """All strings of the surroundings, for comparison over all tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "kind"))
            for lo in range(0, batch.num_rows, 256):
                row, start, (h1, h2) = _strings_of(batch, lo, min(lo + 256, batch.num_rows), length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (sid[row], start.astype(np.int32), kind[row], h1.view(np.int64), h2.view(np.int64))],
                    names=["sid", "start", "kind", "h1", "h2"])
    return run


_CONTEXT = pa.schema([("piece", pa.int64()), ("sid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("kind", pa.int32()),
                      ("context", pa.binary())])


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for text, needs in zip(batch.column("text"), batch.column("needs")):
                raw = text.as_py().encode()
                piece, sid, lo, hi, kind = (needs.values.field(f).to_pylist() for f in ("piece", "sid", "lo", "hi", "kind"))
                for row in zip(piece, sid, lo, hi, kind):
                    out.append((*row, raw[row[2]:row[3] + length]))
                    size += length
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CONTEXT)], schema=_CONTEXT)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CONTEXT)], schema=_CONTEXT)
    return run


def _checked(texts: DataFrame, shared: DataFrame, agreeing: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Covered spans (sid, a, b): those that follow from agreeing
    neighbours, and those found by comparing the other strings."""
    # the agreement that reaches furthest among those that begin before an anchor's first string
    events = shared.select("sid", F.col("lo").alias("x"), F.lit(1).alias("last"), F.lit(None).cast("struct<until:int,prefix:bigint,pos:int>").alias("run"),
                           "t1", "t2", "pos", "lo", "hi", "piece") \
        .unionByName(agreeing.select("sid", F.col("pos").alias("x"), F.lit(0).alias("last"), F.struct("until", "prefix", "pos").alias("run")),
                     allowMissingColumns=True)
    so_far = Window.partitionBy("sid").orderBy("x", "last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = stored(events.withColumn("run", F.max("run").over(so_far)).where("last = 1")
                         .withColumn("inside", F.coalesce(F.col("run.until") >= F.col("hi") + length, F.lit(False))), "judged")
    inside = judged.where("inside")
    follows = inside.select("sid", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))

    open_ = judged.where(~F.col("inside")).select("piece", "sid", "t1", "t2", "lo", "hi", F.lit(0).alias("kind"))
    # kinds are made before the join: a piece that recurs all over a text has few of them
    kinds = (inside.groupBy("piece", F.col("run.prefix").alias("prefix"), (F.col("pos") - F.col("run.pos")).alias("ahead"))
             .agg(F.min(F.struct("sid", "t1", "t2", "lo", "hi")).alias("one"))
             .join(open_.select("piece").distinct(), "piece", "left_semi")
             .select("piece", "one.*", F.lit(1).alias("kind")))
    need = stored(open_.unionByName(kinds.select(*open_.columns)), "need")
    needs = need.groupBy("t1", "t2").agg(F.collect_list(F.struct("piece", "sid", "lo", "hi", "kind")).alias("needs"))
    wanted = texts.join(bounded(need.select("t1", "t2").distinct()), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    contexts = stored(wanted.join(needs, ["t1", "t2"]).select("text", "needs").mapInArrow(
        _contexts(length), "piece long, sid long, lo int, hi int, kind int, context binary"), "contexts")
    many = need.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("piece")
    few = contexts.join(many, "piece", "left_anti").repartition("piece").sortWithinPartitions("piece") \
        .mapInArrow(_check(length), "sid long, a int, b int")
    rows = contexts.join(many, "piece", "left_semi").mapInArrow(_string_rows(length), "sid long, start int, kind int, h1 long, h2 long")
    twice = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    hot = rows.where("kind = 0").join(twice, ["h1", "h2"]).select("sid", F.col("start").alias("a"), (F.col("start") + length).alias("b"))
    return follows, few.unionByName(hot)


# ------------------------------------------------------------------- removal
def _remove(text_col: str, raw_col: str, spans_col: str, kept_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for text, raw in zip(batch.column(text_col), batch.column(raw_col)):
                data, merged = text.as_py().encode(), []
                for a, b in sorted(zip(*(raw.values.field(f).to_pylist() for f in ("a", "b")))):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                at, left = 0, []
                for a, b in merged:
                    left.append(data[at:a])
                    at = b
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join([*left, data[at:]]))
            names = [c for c in batch.schema.names if c != raw_col]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                names=[*names, spans_col, kept_col])
    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   out: tuple[str, str] = ("spans", "kept")) -> DataFrame:
    """Adds the removed byte spans (array of start, end) and the bytes kept."""
    spans_col, kept_col = out
    t1, t2 = F.xxhash64(text_col), F.hash(text_col)
    texts = docs.where(F.octet_length(text_col) >= length).select(F.col(text_col).alias("text"), t1.alias("t1"), t2.alias("t2"))
    found = materialize(texts.mapInArrow(_anchor_rows(length, gram), T.StructType.fromDDL(
        "sid long, t1 long, t2 int, n int, at int, pos int, lo int, hi int, until int, size int, piece long, symbol long, prefix long")), "anchors")

    # equal texts: one stands for all, and goes as a whole
    equal = stored(found.where("at = 0").groupBy("t1", "t2", "n").agg(F.min("sid").alias("sid"), F.count(F.lit(1)).alias("copies")), "texts")
    others = found.where("at = 0").join(bounded(equal.select("sid")), "sid", "left_anti").select("sid")
    single = found.join(bounded(stored(others, "copies")), "sid", "left_anti")
    met = single.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("piece")
    shared = stored(single.join(bounded(stored(met, "pieces")), "piece", "left_semi"), "shared")
    agreeing = stored(_agreeing(shared, 2 * (length - gram + 1) + length), "agreeing")
    follows, checked = _checked(texts, shared, agreeing, length)
    whole = equal.where("copies > 1").select("sid", F.lit(0).alias("a"), F.col("n").alias("b"))
    spans = stored(follows.unionByName(checked).unionByName(whole), "spans")

    k1, k2, raw = fresh(docs, "t1", "t2", "raw")
    by_text = spans.join(equal.select("sid", "t1", "t2"), "sid").groupBy(F.col("t1").alias(k1), F.col("t2").alias(k2)).agg(
        F.collect_list(F.struct("a", "b")).alias(raw))
    by_text = stored(by_text, "spans-by-text")
    keyed = docs.withColumns({k1: t1, k2: t2})
    keys = bounded(by_text.select(k1, k2))
    hit = keyed.join(keys, [k1, k2], "left_semi").join(by_text, [k1, k2]).select(*[F.col(f"`{c}`") for c in docs.columns], raw)
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(spans_col, span_type), T.StructField(kept_col, T.BinaryType())])
    cut = hit.mapInArrow(_remove(text_col, raw, spans_col, kept_col), schema)
    rest = keyed.join(keys, [k1, k2], "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns], F.array().cast(span_type).alias(spans_col),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias(kept_col))
    return cut.unionByName(rest)
