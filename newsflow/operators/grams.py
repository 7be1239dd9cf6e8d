"""Grams (tokens and pairs of adjacent tokens) with their document frequencies.

No gram travels as a string, and no row is made for a gram of a document
before it is among the document's best:

* Documents are written once in *blocks* of up to ``BLOCK`` tokens: token
  numbers (frequent ones are small) and the block's words. Texts are tokenised
  for this alone.
* Every block sends each of its grams once: 96 bits of hash, sorted (so the
  differences of the first 64 bits are sent), and the number of its documents
  that hold the gram, in slices of the hash space.
* Who has a slice adds up the numbers of equal hashes and answers every block
  in the order of its grams: a byte or so each.
* A block and its answers meet, and the best grams of each document leave.

What is shuffled is about 9 bytes for a gram of a block and the blocks
themselves; memory is that of a block or of a slice, whose number grows with
the tokens. Two of 10 ** 9 grams share their 96 bits in one of 10 ** 11 runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

BLOCK = 1 << 20         # tokens of a block, or one document
LEAST_SLICES = 64       # of the hash space; more beyond BLOCK / 2 tokens each


def _slices(batch: pa.RecordBatch, col: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``most`` elements (or one row)."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(col)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        upto = max(upto, at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as planes of their bytes, the lowest first, without the
    planes that are 0 everywhere."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize)
    return planes[:, :max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)].T.tobytes()


def unpacked(data, n: int, kind=np.int64) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    if n:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, :len(planes)] = planes.T
    return out.view(kind).ravel()


def _block(parts: list[pa.RecordBatch]) -> tuple[pa.Array, bytes, bytes, str, int]:
    """(ids, sizes, codes, words, tokens) of rows (id, tokens)."""
    rows = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    size = pc.fill_null(pc.list_value_length(rows.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = rows.column(1).flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    often = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(often), np.int64)
    rank[often] = np.arange(len(often))
    return rows.column(0), packed(size), packed(rank[codes]), "\n".join(coded.dictionary.take(pa.array(often)).to_pylist()), len(codes)


def token_blocks(docs: DataFrame, most: int) -> DataFrame:
    """Rows (id, tokens) in blocks, each a row: its number of rows, ids, sizes,
    codes and words."""
    kind = docs.schema[0]
    schema = T.StructType([T.StructField("docs", T.LongType()), T.StructField("ids", T.ArrayType(kind.dataType)),
                           T.StructField("sizes", T.BinaryType()), T.StructField("codes", T.BinaryType()),
                           T.StructField("words", T.StringType()), T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given():
            ids, sizes, codes, words, n = _block(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([len(ids)]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([sizes], pa.binary()),
                 pa.array([codes], pa.binary()), pa.array([words], pa.string()), pa.array([n])], names=schema.names)

        held, total = [], 0
        for batch in batches:
            for part in _slices(batch, 1, most):
                n = pc.sum(pc.list_value_length(part.column(1))).as_py() or 0
                if held and total + n > most:
                    yield given()
                    held, total = [], 0
                held.append(part)
                total += n
        if held:
            yield given()

    return docs.mapInArrow(run, schema)


class Grams:
    """What a block holds. A gram's number is its word's, or that of its pair
    after all words."""

    def __init__(self, n_docs: int, sizes: bytes, codes: bytes, words: str, tokens: int):
        code = unpacked(codes, tokens)
        self.words = words.split("\n") if tokens else []
        row, many = np.repeat(np.arange(n_docs), unpacked(sizes, n_docs)), max(len(self.words), 1)
        same = row[1:] == row[:-1]
        both, pair = np.unique(code[:-1][same] * many + code[1:][same], return_inverse=True)
        self.first, self.second = both // many, both % many
        key = np.concatenate([code, pair + len(self.words)]) * max(n_docs, 1) + np.concatenate([row, row[1:][same]])
        key, self.tf = np.unique(key, return_counts=True)
        self.gram, self.row = key // max(n_docs, 1), key % max(n_docs, 1)       # of each gram of a document
        self.held_by = np.bincount(self.gram, minlength=len(self.words) + len(both))
        self._hash()

    def _hash(self) -> None:
        """The two hashes of every gram and the order in which grams travel."""
        one, two = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in self.words), "<u8").reshape(-1, 2).T
        one, two = (np.concatenate([x, _mix(x[self.first] * np.uint64(odd) + _mix(x[self.second] ^ np.uint64(odd)))])
                    for x, odd in ((one, 0x9E3779B97F4A7C15), (two, 0xD1B54A32D192ED03)))
        self.order = np.argsort(one, kind="stable")
        self.one, self.two = one[self.order], (two[self.order] >> np.uint64(32)).astype(np.uint32)

    def strings(self, grams: np.ndarray) -> pa.Array:
        words, pairs = pa.array(self.words, pa.string()), grams >= len(self.words)
        out = np.empty(len(grams), object)
        out[~pairs] = words.take(pa.array(grams[~pairs])).to_pylist()
        both = grams[pairs] - len(self.words)
        out[pairs] = pc.binary_join_element_wise(*(words.take(pa.array(x[both])) for x in (self.first, self.second)), " ").to_pylist()
        return pa.array(out, pa.string())

    def places(self) -> np.ndarray:
        """Of every gram, a number in the order of the grams' bytes: a space is
        before all that is in a word."""
        rank = np.empty(len(self.words), np.int64)
        rank[pc.sort_indices(pa.array(self.words, pa.string())).to_numpy()] = np.arange(len(self.words))
        many = len(self.words) + 1
        return np.concatenate([rank * many, rank[self.first] * many + rank[self.second] + 1])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BLOCK_COLUMNS = "docs", "sizes", "codes", "words", "tokens"


def _block_of(batch: pa.RecordBatch, i: int) -> Grams:
    return Grams(*(batch.column(c)[i].as_py() for c in BLOCK_COLUMNS))


def _sent(bits: int):
    """Blocks -> (slice, block, grams, first, second, docs): a slice's share
    of a block's grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                g = _block_of(batch, i)
                held_by = g.held_by[g.order]
                cuts = np.searchsorted(g.one >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                rows = []
                for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                    part = slice(cuts[s], cuts[s + 1])
                    rows.append((s, block, cuts[s + 1] - cuts[s], packed(np.diff(g.one[part], prepend=np.uint64(s) << np.uint64(64 - bits))),
                                 g.two[part].tobytes(), packed(held_by[part])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _SENT_TYPES)], names=_SENT_NAMES)
    return run


_SENT = "slice int, block long, grams int, first binary, second binary, docs binary"
_SENT_TYPES = pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
_SENT_NAMES = "slice", "block", "grams", "first", "second", "docs"


def _answered(bits: int):
    """Rows of ``_sent`` sorted by slice -> (block, slice, df): the documents
    of all blocks, in the order of the block's grams."""
    def given(s: int, rows: list) -> pa.RecordBatch:
        base = np.uint64(s) << np.uint64(64 - bits)
        one = np.concatenate([np.cumsum(unpacked(r[2], r[1], np.uint64), dtype=np.uint64) + base for r in rows])
        two = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows])
        n = np.concatenate([unpacked(r[4], r[1]) for r in rows])
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        df = np.empty(len(n), np.int64)
        df[order] = np.add.reduceat(n[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        ends = np.cumsum([r[1] for r in rows]).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([s] * len(rows), pa.int32()),
             pa.array([packed(df[end - r[1]:end]) for r, end in zip(rows, ends)], pa.binary()), pa.array([r[1] for r in rows], pa.int32())],
            names=["block", "slice", "df", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for s, *row in zip(*(batch.column(c).to_pylist() for c in _SENT_NAMES)):
                if s != now and held:
                    yield given(now, held)
                    held = []
                now = s
                held.append(row)
        if held:
            yield given(now, held)
    return run


def chosen(row: np.ndarray, score: np.ndarray, place: np.ndarray, most: int, unit: float) -> np.ndarray:
    """Entries that can be among the ``most`` of their row by (score rounded to
    units, place): of equal scores the first ones, and scores so close that
    rounding may turn or level them are not held against each other."""
    order = np.lexsort((place, -score, row))
    row, score, at = row[order], score[order], np.arange(len(order))
    step = score[:-1] - score[1:]
    new_row = np.r_[True, row[1:] != row[:-1]][:len(order)]
    new_score = new_row | np.r_[True, step != 0][:len(order)]
    apart = new_row | np.r_[True, step > 2.5 * unit + 1e-13 * score[:-1]][:len(order)]
    begin = lambda flags: np.maximum.accumulate(np.where(flags, at, 0))
    return order[begin(apart) - begin(new_row) + at - begin(new_score) < most]


def _best(kind: T.StructField, n_docs: int, most: int, digits: int):
    """Blocks, each followed by its answers -> (id, gram, tf, df)."""
    def given(batch: pa.RecordBatch, i: int, answers: list) -> pa.RecordBatch:
        g = _block_of(batch, i)
        df = np.empty(len(g.order), np.int64)
        df[g.order] = np.concatenate([unpacked(data, n) for data, n in answers])
        df = df[g.gram]
        some = chosen(g.row, g.tf * np.log((n_docs + 1) / (df + 1)), g.places()[g.gram], most, 10.0 ** -digits)
        ids = batch.column("ids").slice(i, 1).flatten()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(g.row[some])), g.strings(g.gram[some]), pa.array(g.tf[some], pa.int64()), pa.array(df[some])],
                                          names=[kind.name, "gram", "tf", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers = None, []
        for batch in batches:
            data, n = batch.column("df"), batch.column("grams").to_pylist()
            for i, s in enumerate(batch.column("slice").to_pylist()):
                if s < 0:
                    if answers:
                        yield given(*now, answers)
                    now, answers = (batch, i), []
                else:
                    answers.append((data[i].as_py(), n[i]))
        if answers:
            yield given(*now, answers)
    return run


def best_grams(docs: DataFrame, most: int, digits: int) -> tuple[DataFrame, int]:
    """((id, gram, tf, df), number of rows): of each row (id, tokens) of
    ``docs`` the ``most`` grams with the greatest tf * ln((N + 1) / (df + 1)),
    rounded, equal ones by their bytes; a few more where rounding decides."""
    kind = docs.schema[0]
    blocks = materialize(token_blocks(docs, BLOCK).withColumn("block", F.monotonically_increasing_id()), "token-blocks")
    total, n_docs = blocks.agg(F.sum("tokens"), F.sum("docs")).first()
    bits = math.ceil(math.log2(max(LEAST_SLICES, 2 * (total or 0) / BLOCK)))
    blocks = blocks.where("tokens > 0")
    sent = blocks.drop("ids").mapInArrow(_sent(bits), _SENT).repartition("slice").sortWithinPartitions("slice")
    answers = materialize(sent.mapInArrow(_answered(bits), "block long, slice int, df binary, grams int"), "gram-answers")
    met = blocks.withColumn("slice", F.lit(-1)).unionByName(answers, allowMissingColumns=True)
    met = met.repartition("block").sortWithinPartitions("block", "slice")
    schema = T.StructType([kind, T.StructField("gram", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("df", T.LongType())])
    return met.mapInArrow(_best(kind, n_docs or 0, most, digits), schema), n_docs or 0
