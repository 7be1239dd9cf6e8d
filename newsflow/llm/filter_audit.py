"""Filter interaction audit: what every order of a filter chain removes.

A chain of k filters has k! orders. A document is described by its *mask*,
the set of filters that it fails; an order removes it at its first filter
that is in the mask. Orders are numbered by their Lehmer rank, that is
lexicographically, so all orders that begin alike are one interval of ranks:
a beginning that avoids the mask and ends with a filter of it fixes the
removal step for (k - length)! consecutive ranks.

* masks: tasks read whole texts once and give out one narrow row per
  document; equal texts are found by a 128-bit hash, whose least id is a
  partial aggregate, so a text that a third of all documents share is reduced
  map side, and the join that marks the least ids has the id in its key;
* difference arrays: the counts of a part's masks (at most 2 ** k rows) are
  added where an interval of ranks begins and taken off where it ends;
* prefix sums over the ranks of every (part, step) give what is removed. A
  part has k * k! rows, whatever the number of documents.

The tables of intervals and orders are made by rule and hold about a thousand
rows for five filters; only they are broadcast.

Defined results: a NULL or empty text has no words and no characters, so it
fails A and, if a smaller id is also empty, E, but never B, C or D; a NULL id
has no labels and never fails E, nor does it make another document fail;
repeated rows with one id count each, and do not make each other fail E;
several label rows of one id are taken together (1 in any of them); a NULL
part is the empty string; no documents give no rows. Other columns of either
table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import utf8_of, worker_cache
from .words import word_chunks

FILTERS = "ABCDE"
MIN_WORDS = 200
_EVERY = bytes(range(256))
_NOT_UPPER = bytes(set(_EVERY) - set(range(65, 91)))
_NOT_MARK = bytes(set(_EVERY) - set(b"#$%&*|"))
_CONTINUATION = bytes(range(0x80, 0xC0))


def failures(data: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    n, distinct = 0, set()
    for words in word_chunks(data):
        n += len(words)
        distinct.update(words)
    points = len(data.translate(None, _CONTINUATION))
    upper = len(data.translate(None, _NOT_UPPER))
    return ((n < MIN_WORDS) | (100 * len(distinct) < 50 * n) << 1 | (100 * upper > 3 * points) << 2
            | bool(data.translate(None, _NOT_MARK)) << 3)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, text) to (id, part, h1, h2, mask)."""
    worker_cache("audit")
    for batch in batches:
        data, offsets = utf8_of(batch.column(2))
        masks, hashes = np.zeros(batch.num_rows, np.int32), bytearray()
        for i in range(batch.num_rows):
            text = data[offsets[i]:offsets[i + 1]].tobytes()
            masks[i] = failures(text)
            hashes += xxhash.xxh3_128_digest(text)
        halves = np.frombuffer(bytes(hashes), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.ascontiguousarray(halves[:, 0])),
             pa.array(np.ascontiguousarray(halves[:, 1])), pa.array(masks)], names=["id", "part", "h1", "h2", "mask"])


def filter_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) per document, mask the bits of the five filters."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    base = materialize(rows.mapInArrow(_describe, f"id {kind}, part string, h1 long, h2 long, mask int"), "masks")
    least = base.where(F.col("id").isNotNull()).groupBy("h1", "h2").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    later = F.col("first").isNull() & F.col("id").isNotNull()
    return base.join(least, ["id", "h1", "h2"], "left").select(
        "id", "part", F.when(later, F.col("mask").bitwiseOR(F.lit(16))).otherwise(F.col("mask")).alias("mask"))


def orders(names: Sequence[str]) -> Iterator[tuple[int, tuple[str, ...]]]:
    """(rank, order) in lexicographic order of positions in ``names``."""
    yield from enumerate(permutations(names))


def removal_intervals(k: int) -> Iterator[tuple[int, int, int, int]]:
    """(mask, step, low, high): the ranks low to high - 1 remove a document
    with this mask at this step (from 1)."""
    def begin(mask, left, low, step):
        width = factorial(len(left) - 1)
        for i, f in enumerate(left):
            at = low + i * width
            if mask >> f & 1:
                yield mask, step, at, at + width
            else:
                yield from begin(mask, left[:i] + left[i + 1:], at, step + 1)
    for mask in range(1, 1 << k):
        yield from begin(mask, tuple(range(k)), 0, 1)


def _fixed(spark: SparkSession, rows, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def audit(masked: DataFrame, names: Sequence[str] = FILTERS) -> DataFrame:
    """Per part, order and step: (part, filter_order, step, filter, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley).
    ``masked`` has part, mask, good and toxic (booleans) per document."""
    k, spark = len(names), masked.sparkSession
    weights = ("n", "good", "toxic")
    one = [F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")]
    masks = materialize(masked.groupBy("part", "mask").agg(*one), "mask-counts")

    # difference arrays over the ranks of a (part, step), then their prefix sums
    intervals = _fixed(spark, removal_intervals(k), "mask int, step int, low int, high int")
    ends = F.explode(F.array(F.struct(F.col("low").alias("rank"), F.lit(1).alias("sign")),
                             F.struct(F.col("high").alias("rank"), F.lit(-1).alias("sign")))).alias("end")
    steps = masks.join(intervals, "mask").select("part", "step", *weights, ends)
    steps = steps.select("part", "step", "end.rank", *[(F.col("end.sign") * F.col(w)).alias(w) for w in weights])
    grid = _fixed(spark, ((rank * k + step, rank, step, order[step - 1], "".join(order)) for rank, order in orders(names)
                          for step in range(1, k + 1)), "cell int, rank int, step int, filter string, filter_order string")
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)).alias(f"fails_{i}") for i in range(k)]
    only = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"only_{i}") for i in range(k)]
    totals = masks.groupBy("part").agg(F.sum("n").alias("total"), *fails, *only)
    changes = steps.groupBy("part", "step", "rank").agg(*[F.sum(w).alias(w) for w in weights])
    every = F.explode(F.sequence(F.lit(1), F.lit(k * factorial(k)))).alias("cell")      # k * k! cells to a part
    cells = totals.select("*", every).join(grid, "cell").join(changes, ["part", "step", "rank"], "left")
    prefix = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    for w in weights:
        cells = cells.withColumn(w, F.coalesce(F.sum(w).over(prefix), F.lit(0)).cast("long"))

    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    here = {f: i for i, f in enumerate(names)}
    return cells.select(
        "part", "filter_order", "step", "filter", (F.col("total") - F.sum("n").over(so_far)).alias("kept"),
        F.col("n").alias("removed"), (_own(here, "fails") - F.col("n")).alias("redundant"), _own(here, "only").alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"))


def _own(names: dict[str, int], what: str) -> Column:
    """The count that belongs to a row's own filter."""
    out = F.lit(None).cast("long")
    for name, i in names.items():
        out = F.when(F.col("filter") == name, F.col(f"{what}_{i}")).otherwise(out)
    return out


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    part_col: str = "lang") -> DataFrame:
    """The audit of the five filters over whole texts."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    masked = filter_masks(docs, id_col, text_col, part_col).join(marks, "id", "left")
    return audit(masked.select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]))
