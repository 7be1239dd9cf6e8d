"""SimHash near-duplicates through a byte-position inverted index.

Fingerprints (64 bit) are bitwise majorities over the XXH64 values of a
text's word shingles. Two fingerprints that differ in at most 4 bits differ
in at most 4 of their 8 bytes, so they share at least 8 - 4 = 4 *positional
bytes*. That guaranteed minimum drives the search:

* index: posting lists are kept for combinations of three positional bytes.
  Twenty combinations are enough for every set of four positions to contain
  one of them (a Turán system), so every pair with four shared bytes meets
  in a list, while a list over one positional byte alone would hold 1/256 of
  all documents and be quadratic;
* count filter: the shared positional bytes of a pair met in a list are
  tallied, and only pairs that reach the minimum are retained;
* verify: the differing bits of the retained pairs are counted.

Equal fingerprints are collapsed before indexing (copies never meet each
other). A list is worked on inside one task and gives out a spanning forest
of its verified links, at most one row less than it has members, instead of
all pairs: connectivity is all that the components need. A list longer than
``long_list`` is dealt again under every possible fourth shared byte (which
the minimum guarantees), so it is split over tasks without losing a pair.

Defined results: a text without words (NULL, empty, white space) has
fingerprint 0, which is linked like any other; a NULL id takes part but
never names a component unless all ids of it are NULL; repeated rows are all
kept by ``near_duplicates`` and one of them by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import fresh, key_runs, worker_cache
from .components import components
from .line_dedup import bounded

SEED = 42
CHUNK = 4 << 20        # bytes of a text worked on at a time
TILE = 2048            # members of a list compared at a time
SPACE = b" \t\n\x0b\x0c\r"


def _turan_triples() -> list[tuple[int, ...]]:
    """Triples of byte positions such that any four positions contain one:
    three groups in a ring, triples inside a group or with two in a group
    and one in the next."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for g in groups for t in combinations(g, 3)]
    for g, nxt in zip(groups, groups[1:] + groups[:1]):
        out += [tuple(sorted((*two, one))) for two in combinations(g, 2) for one in nxt]
    return out


TRIPLES = _turan_triples()


def _words(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, in lists that cover about CHUNK bytes each."""
    if len(data) <= CHUNK:
        yield data.split()
        return
    tail = b""
    for lo in range(0, len(data), CHUNK):
        piece = tail + data[lo:lo + CHUNK]
        words, tail = piece.split(), b""
        if lo + CHUNK < len(data) and words and piece[-1] not in SPACE:
            tail = words.pop()
        yield words
    if tail:
        yield [tail]


def _bit_counts(words: list[bytes], k: int) -> tuple[np.ndarray, int]:
    """(how many shingle hashes have each bit, most significant first; shingles)."""
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[:len(words) - k + 1].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1:].tolist())])
    rows = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for lo in range(0, len(rows), 4096):
        total += np.unpackbits(rows[lo:lo + 4096], axis=1).sum(axis=0, dtype=np.int32)
    return total, len(rows)


def fingerprint(text: str | None, k: int) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    total, m, carry, words = np.zeros(64, np.int64), 0, [], 0
    for some in _words((text or "").encode().lower()):
        words += len(some)
        some = carry + some
        if len(some) >= k:
            counts, n = _bit_counts(some, k)
            total, m = total + counts, m + n
        carry = some[-(k - 1):] if k > 1 else []
    if words and not m:  # fewer words than a shingle: the whole sequence
        total, m = _bit_counts(carry, len(carry))
    return int.from_bytes(np.packbits(2 * total > m).tobytes(), "big") if m else 0


def _fingerprints(text_col: str, k: int, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for batch in batches:
            col = batch.column(text_col)
            prints = np.fromiter((fingerprint(col[i].as_py(), k) for i in range(len(col))), np.uint64, len(col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))],
                                             names=[*batch.schema.names, out])
    return run


def fingerprints(docs: DataFrame, text_col: str = "text", k: int = 4, out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as a long (two's complement)."""
    return docs.mapInArrow(_fingerprints(text_col, k, out),
                           T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def _byte(pos: int):
    return F.shiftrightunsigned(F.col("fp"), 8 * pos).bitwiseAND(F.lit(255).cast("long"))


def _posting(positions: tuple[int, ...], number: int):
    """Key of a posting list: its number and its positional bytes."""
    key = F.lit(number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(p))
    return key


def _forest(prints: np.ndarray, max_bits: int, min_bytes: int) -> tuple[list[int], list[int]]:
    """Spanning forest of the verified links between distinct fingerprints:
    breadth first from every unvisited member, a tile of comparisons at a time."""
    left, right = [], []
    rest = prints
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            found, parents = np.zeros(len(rest), bool), np.zeros(len(rest), np.uint64)
            for lo in range(0, len(front), 64):
                some = front[lo:lo + 64]
                for at in range(0, len(rest), TILE):
                    part = slice(at, at + TILE)
                    diff = some[:, None] ^ rest[None, part]
                    as_bytes = diff.view(np.uint8).reshape(*diff.shape, 8)
                    shared = (as_bytes == 0).sum(axis=2, dtype=np.uint8)       # tally
                    ok = (shared >= min_bytes) & (np.bitwise_count(diff) <= max_bits)  # retain, verify
                    hit = ok.any(axis=0)
                    new = hit & ~found[part]
                    parents[part][new] = some[ok.argmax(axis=0)[new]]
                    found[part] |= hit
            left += parents[found].view(np.int64).tolist()
            right += rest[found].view(np.int64).tolist()
            front, rest = rest[found], rest[~found]
    return left, right


def _list_links(max_bits: int):
    min_bytes = 8 - max_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in key_runs(batches):
            key = batch.column(0).to_numpy(zero_copy_only=False)
            prints = np.ascontiguousarray(batch.column(1).to_numpy(zero_copy_only=False)).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            left, right = [], []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                if e - s == 2:
                    d = int(prints[s]) ^ int(prints[s + 1])
                    if d and d.bit_count() <= max_bits:  # 4 bits or fewer leave 4 bytes alone
                        left.append(int(prints[s].view(np.int64)))
                        right.append(int(prints[s + 1].view(np.int64)))
                    continue
                a, b = _forest(np.unique(prints[s:e]), max_bits, min_bytes)
                left += a
                right += b
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
    return run


def links(prints: DataFrame, max_bits: int = 4, long_list: int = 50_000) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``prints`` (fp),
    enough of them to connect what is connected."""
    if max_bits != 4:
        raise ValueError("the posting lists are made for 4 differing bits")
    postings = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("list"), _posting(t, i).alias("key")) for i, t in enumerate(TRIPLES)])).alias("p"))
    postings = postings.select("fp", "p.list", "p.key")
    long_ = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long_list)
    # a fourth shared byte is guaranteed: long lists are dealt by each choice of it
    fourth = [F.array(*[F.shiftleft(F.col("key"), 12).bitwiseOR(F.shiftleft(F.lit(p + 1).cast("long"), 8)).bitwiseOR(_byte(p))
                        for p in range(8) if p not in t]) for t in TRIPLES]
    choice = F.element_at(F.array(*fourth), F.col("list") + 1)
    keyed = (postings.join(long_, "key", "left")
             .select("fp", F.explode(F.when(F.col("n").isNull(), F.array("key")).otherwise(choice)).alias("key")))
    dealt = keyed.select("key", "fp").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_list_links(max_bits), "a long, b long")


def _classes(prints: DataFrame, id_col: str, max_bits: int) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of (id, fp)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "prints")
    roots = components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                    max_bits: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) per document: fingerprint as 16 hex
    digits, component_id the least id reachable over links."""
    prints = materialize(fingerprints(docs.select(id_col, text_col), text_col, k, "fp").select(id_col, "fp"), "fp")
    classes = _classes(prints, id_col, max_bits).select("fp", "component_id")
    return (prints.join(classes, "fp")
            .select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                         max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` with one document of each component, that of the
    least id; of repeated rows with that id one is kept."""
    fp, root, least, n = fresh(docs, "fp", "root", "component_id", "n")
    stored = materialize(fingerprints(docs, text_col, k, fp), "docs-fp")
    prints = stored.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"))
    classes = materialize(_classes(prints, "id", max_bits), "classes")
    rows = prints.join(classes, "fp")
    same = rows.where(F.col("id").eqNullSafe(F.col("component_id")))
    counts = same.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    # texts are shuffled only where a component has several rows
    several = rows.groupBy("root").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("root")
    keep = materialize(classes.join(several, "root", "left_semi").join(counts, "root")
                       .select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(least), F.col("n").alias(n)), "keep")
    alone = stored.join(bounded(keep.select(fp)), fp, "left_anti")
    kept = stored.join(bounded(keep.select(fp)), fp, "left_semi").join(keep, fp).where(F.col(id_col).eqNullSafe(F.col(least)))
    # only ids that occur more than once need a second shuffle
    once = kept.where(F.col(n) == 1)
    more = kept.where(F.col(n) > 1).dropDuplicates([root])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return alone.select(*columns).unionByName(once.select(*columns)).unionByName(more.select(*columns))
