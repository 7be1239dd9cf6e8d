"""Byte-level BPE encoding and decoding with a rank queue.

A text is cut into pre-tokens by the vocabulary's pattern and every
pre-token is merged on its own. The merge loop keeps the token boundaries as
a linked list over byte positions and the mergeable pairs in a bucket queue
indexed by merge rank: a hierarchical bitmap tells by two find-first-set
steps which rank comes next, the bucket of that rank holds the positions
waiting for it (leftmost first), and an entry whose pair has changed
meanwhile is skipped when it is met. A
pre-token of n bytes so costs O(n log n) at worst, whatever its length.

Each Python worker keeps the ids of short pre-tokens it has already merged
(bounded, a pure cache), so a pre-token is merged about once per worker.
Texts are streamed: long ones are pre-tokenised lazily and the output is cut
into bounded Arrow batches.

The vocabulary is a rank file (base64 token, rank; one per line) whose path
is a parameter. The driver reads it and broadcasts its bytes: the size is
that of the file and is checked against ``MAX_VOCAB_BYTES``.

Defined results: a NULL or empty text has no ids; ids are packed as
little-endian unsigned 32-bit integers; the other columns of the input are
passed through untouched, except that columns named like an added one are
replaced.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import worker_cache

MAX_VOCAB_BYTES = 64 << 20
LONG_TEXT = 1 << 20       # characters from which pre-tokens are drawn lazily
CACHED_BYTES = 48         # longest pre-token that is remembered
CACHED_PIECES = 300_000   # of a generation; there are two
OUT_BYTES = 8 << 20       # bytes of one output batch


class RankQueue:
    """Positions bucketed by rank below a two-level bitmap. The words of the
    lower level have as many bits as there are words (Python's integers take
    any width), so the least rank is found by two find-first-set steps."""

    __slots__ = ("shift", "mask", "words", "top", "buckets")

    def __init__(self, n_ranks: int):
        self.shift = max(1, (n_ranks.bit_length() + 1) // 2)
        self.mask = (1 << self.shift) - 1
        self.words = [0] * ((n_ranks >> self.shift) + 1)
        self.top = 0
        self.buckets: dict[int, int | list[int]] = {}  # one position, or a heap of several

    def push(self, rank: int, pos: int) -> None:
        buckets = self.buckets
        if rank in buckets:
            waiting = buckets[rank]
            if type(waiting) is int:
                buckets[rank] = [waiting, pos] if waiting < pos else [pos, waiting]
            else:
                heapq.heappush(waiting, pos)
            return
        buckets[rank] = pos
        i = rank >> self.shift
        self.words[i] |= 1 << (rank & self.mask)
        self.top |= 1 << i

    def pop(self) -> tuple[int, int]:
        """The leftmost position of the least rank."""
        top = self.top
        i = (top & -top).bit_length() - 1
        word = self.words[i]
        bit = word & -word
        rank = (i << self.shift) + bit.bit_length() - 1
        waiting = self.buckets[rank]
        if type(waiting) is not int:
            pos = heapq.heappop(waiting)
            if len(waiting) == 1:
                self.buckets[rank] = waiting[0]
            return rank, pos
        del self.buckets[rank]
        word ^= bit
        self.words[i] = word
        if not word:
            self.top = top & (top - 1)
        return rank, waiting


class Merger:
    """Merges pre-tokens by a rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)

    def encode(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n, queue, get = len(piece), self.queue, ranks.get
        push, pop = queue.push, queue.pop
        right = list(range(1, n + 1))       # start of the next token
        left = list(range(-1, n - 1))       # start of the token before
        # rank of a token merged with the next one, -1: none, or no token starts here
        pair = [get(piece[i:i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        for i, rank in enumerate(pair):
            if rank >= 0:
                push(rank, i)
        while queue.top:
            rank, i = pop()
            if pair[i] != rank:             # stale: a neighbour was merged since
                continue
            j = right[i]
            right[i] = k = right[j]
            pair[j] = rank = -1
            if k < n:
                left[k] = i
                rank = get(piece[i:right[k]], -1)
                if rank >= 0:
                    push(rank, i)
            pair[i] = rank
            p = left[i]
            if p >= 0:
                pair[p] = rank = get(piece[p:k], -1)
                if rank >= 0:
                    push(rank, p)
        ids, i = [], 0
        while i < n:
            k = right[i]
            ids.append(ranks[piece[i:k]])
            i = k
        return ids


class PieceCache(dict):
    """Packed ids by pre-token; a missing one is merged. When the cache is
    full it becomes the older generation, from which what is met again is
    taken over, so frequent pre-tokens stay."""

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger, self.older = merger, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            raw = piece.encode()
            packed = np.asarray(self.merger.encode(raw), dtype="<u4").tobytes()
            if len(raw) > CACHED_BYTES:
                return packed
        if len(self) >= CACHED_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = packed
        return packed


class Codec:
    """A vocabulary and its pre-token pattern, in one Python process."""

    def __init__(self, vocab: bytes, pattern: str):
        import regex

        ranks = {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, vocab.splitlines()) if tok}
        self.tokens = {rank: tok for tok, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.cache = PieceCache(Merger(ranks))

    def encode(self, text: str) -> bytes:
        packed = self.cache.__getitem__
        if len(text) < LONG_TEXT:
            return b"".join(map(packed, self.pattern.findall(text)))
        pieces = (m.group() for m in self.pattern.finditer(text))
        return b"".join(b"".join(map(packed, some)) for some in itertools.batched(pieces, 1 << 16))

    def decode(self, ids: bytes) -> bytes:
        token = self.tokens.__getitem__
        numbers = np.frombuffer(ids, dtype="<u4")
        return b"".join(b"".join(map(token, numbers[i:i + (1 << 16)].tolist()))
                        for i in range(0, len(numbers), 1 << 16))


def _codec(vocab, pattern: str) -> Codec:
    """The process's codec for a broadcast vocabulary."""
    data, codecs = vocab.value, worker_cache("bpe")
    key = (hash(data), pattern)
    if key not in codecs:
        codecs.clear()
        codecs[key] = Codec(data, pattern)
    return codecs[key]


def _with_columns(batch: pa.RecordBatch, lo: int, hi: int, added: dict[str, pa.Array]) -> pa.RecordBatch:
    part = batch.slice(lo, hi - lo)
    kept = [(n, c) for n, c in zip(part.schema.names, part.columns) if n not in added]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(added.values()),
                                      names=[n for n, _ in kept] + list(added))


def _encode_batches(vocab, pattern: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocab, pattern)
        for batch in batches:
            texts, ids, size, lo = batch.column(text_col), [], 0, 0
            for i in range(batch.num_rows):
                ids.append(codec.encode(texts[i].as_py() or ""))
                size += len(ids[-1])
                if size >= OUT_BYTES or i + 1 == batch.num_rows:
                    counts = pa.array([len(x) >> 2 for x in ids], pa.int64())
                    yield _with_columns(batch, lo, i + 1, {"ids": pa.array(ids, pa.binary()), "n_tokens": counts})
                    ids, size, lo = [], 0, i + 1
    return run


def _decode_batches(vocab, pattern: str, ids_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocab, pattern)
        for batch in batches:
            ids, out, size, lo = batch.column(ids_col), [], 0, 0
            for i in range(batch.num_rows):
                out.append(codec.decode(ids[i].as_py() or b""))
                size += len(out[-1])
                if size >= OUT_BYTES or i + 1 == batch.num_rows:
                    yield _with_columns(batch, lo, i + 1, {"decoded": pa.array(out, pa.binary())})
                    out, size, lo = [], 0, i + 1
    return run


def load_vocab(spark: SparkSession, path: str):
    """Broadcast the bytes of a rank file (a local file of the driver)."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCAB_BYTES + 1)
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} holds more than {MAX_VOCAB_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def _plus(df: DataFrame, **added) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name not in added]
    return T.StructType(kept + [T.StructField(n, t) for n, t in added.items()])


def encode(docs: DataFrame, vocab, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds ids (binary, packed) and n_tokens (long)."""
    return docs.mapInArrow(_encode_batches(vocab, pattern, text_col),
                           _plus(docs, ids=T.BinaryType(), n_tokens=T.LongType()))


def decode(encoded: DataFrame, vocab, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded (binary): the bytes the ids stand for."""
    return encoded.mapInArrow(_decode_batches(vocab, pattern, ids_col), _plus(encoded, decoded=T.BinaryType()))


def round_trip(docs: DataFrame, vocab, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ids, n_tokens and decoded. Both steps
    run in one Python worker per task, batch by batch, which halves the
    workers that hold a vocabulary and a cache."""
    coded = _encode_batches(vocab, pattern, text_col)
    back = _decode_batches(vocab, pattern, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return back(b.drop_columns([text_col]) for b in coded(batches))

    return docs.mapInArrow(run, _plus(docs.drop(text_col), ids=T.BinaryType(), n_tokens=T.LongType(), decoded=T.BinaryType()))
