"""Blocked Bloom filters over 64-bit hashes: a hash sets four bits of one
64-bit block. Filled by Spark expressions, read by numpy in tasks. The number
of blocks has a fixed bound; past it more hashes pass, none is lost."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffles_removed

BITS = 32                # per hash, while the bound allows
MAX_BLOCKS = 1 << 22     # 32 MB
SLICES = 1 << 10         # of the hashes that travel packed
HELD = 1 << 20           # hashes packed at once
PACKED = "slice int, hashes binary"


def sizes(counts: dict[int, int], most: int | None = None, bits: int = BITS) -> dict[int, int]:
    """Blocks of each shard for its number of hashes: ``most`` in all, and one
    more per shard."""
    share = min(bits / 64, (most or MAX_BLOCKS) / max(sum(counts.values()), 1))
    return {s: int(n * share) + 1 for s, n in counts.items()}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bits(h: Column) -> Column:
    out = F.lit(0).cast("long")
    for i in range(4):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


def fill(hashes: DataFrame, blocks: dict[int, int]) -> dict[int, np.ndarray]:
    """The filters of (shard, h): the driver gets the blocks that have bits."""
    out = {s: np.zeros(n, np.uint64) for s, n in blocks.items()}
    if not out:
        return out
    most = F.create_map(*[F.lit(x).cast("long") for pair in blocks.items() for x in pair])[F.col("shard").cast("long")]
    block = F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * most, 32)
    with shuffles_removed(hashes.sparkSession):
        filled = (hashes.select("shard", block.cast("int").alias("block"), _bits(F.col("h")).alias("bits"))
                  .groupBy("shard", "block").agg(F.bit_or("bits").alias("bits")).toArrow())
    at, block, bits = (filled.column(c).to_numpy() for c in ("shard", "block", "bits"))
    for s in out:
        mine = at == s
        out[s][block[mine]] = bits[mine].view(np.uint64)
    return out


def contains(blocks: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the (unsigned) hashes may be in the filter."""
    one, six = np.uint64(1), np.uint64(63)
    bits = np.zeros(h.shape, np.uint64)
    for i in range(4):
        bits |= one << (h >> np.uint64(6 * i) & six)
    block = (h >> np.uint64(32)) * np.uint64(len(blocks)) >> np.uint64(32)
    return blocks[block.astype(np.int64)] & bits == bits


def _places(n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, bits) of hashes in a filter of n blocks."""
    bits = np.zeros(h.shape, np.uint64)
    for i in range(4):
        bits |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64), bits


def sliced(hashes: int, most: int, bits: int = BITS) -> int:
    """Blocks of a filter for so many hashes, a multiple of ``SLICES``."""
    return SLICES * min(most // SLICES, hashes * bits // 64 // SLICES + 1)


def folded(blocks: np.ndarray, full: float = 0.125) -> np.ndarray:
    """The filter in half as many blocks, and again, while no more than this
    share of its bits is set: neighbours are blocks of one number there."""
    while len(blocks) % 2 == 0 and np.bitwise_count(blocks).mean() <= 64 * full:
        blocks = blocks[0::2] | blocks[1::2]
    return blocks


def packed(hashes: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (slice, hashes): the sorted hashes of a slice as bytes."""
    def given():
        h = np.sort(np.concatenate(held))
        cuts = np.searchsorted(h >> np.uint64(54), np.arange(SLICES + 1, dtype=np.uint64))
        some = np.flatnonzero(cuts[1:] > cuts[:-1])
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([h[cuts[s]:cuts[s + 1]].tobytes() for s in some], pa.binary())],
                                          names=["slice", "hashes"])
    held, n = [], 0
    for h in hashes:
        held.append(h)
        n += len(h)
        if n >= HELD:
            yield given()
            held, n = [], 0
    if n:
        yield given()


def _joined(n: int):
    """(slice, once, twice): a slice's share of the filters of all hashes and
    of those that come more than once; rows sorted by slice."""
    width = n // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(blocks, h):
            if len(h):
                block, bits = _places(n, h)     # sorted as the hashes are
                cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                blocks[block[cut] - now * width] |= np.bitwise_or.reduceat(bits, cut)

        def given():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (once, twice)]],
                                              names=["slice", "once", "twice"])
        now = None
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s != now:
                    if now is not None:
                        yield given()
                    now, once, twice = s, np.zeros(width, np.uint64), np.zeros(width, np.uint64)
                h, times = np.unique(np.frombuffer(blob.as_buffer(), np.uint64), return_counts=True)
                block, bits = _places(n, h)
                put(twice, h[(times > 1) | (once[block - now * width] & bits == bits)])
                put(once, h)
        if now is not None:
            yield given()
    return run


def gather(hashes: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The filters (of n blocks, see ``sliced``) of all hashes in ``packed``
    rows and of those that come more than once: the driver gets n blocks each."""
    once, twice = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    width = n // SLICES
    with shuffles_removed(hashes.sparkSession):
        parts = (hashes.repartition("slice").sortWithinPartitions("slice")
                 .mapInArrow(_joined(n), "slice int, once binary, twice binary").toArrow())
    for batch in parts.to_batches():        # read in place: the driver holds them once
        for s, *blobs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            for blocks, blob in zip((once, twice), blobs):
                blocks[s * width:(s + 1) * width] = np.frombuffer(blob.as_buffer(), np.uint64)
    return once, twice
