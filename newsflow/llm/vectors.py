"""A stated query set against all vectors, in blocks.

Vectors are dealt by a hash of their id to blocks of bounded size; every
block is indexed by one task, and every query visits every block. Rows of a
block arrive sorted, data before queries, so a task holds one block and one
Arrow batch of queries at a time, however many queries there are. Each block
gives out its best ``k`` per query, and a rank window (limited before its
shuffle) keeps the best ``k`` over all blocks.

Vectors of different lengths never meet: the length is part of the block.
Identical vectors of a block are cut to their k + 1 smallest ids before
indexing: by the tie rule no other of them can be among the best k of any
query, so a vector that a third of all rows repeat costs no more than k + 1.
Rows repeated as a whole count once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 131_072   # most rows of a block, in the mean
SPREAD_ROWS = 4_096    # smaller blocks are made only to give every core one, not below this


def is_finite(vec: str) -> Column:
    """Not NULL, not empty, no NULL, NaN or infinite component."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf))
    return F.coalesce(F.col(vec).isNotNull() & (F.size(vec) > 0) & fine, F.lit(False))


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """Rows of a list column of equal lengths without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype)


def few_of_each(ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions kept, by ascending id: of identical rows the k + 1 smallest
    distinct ids."""
    order = np.lexsort((np.arange(len(ids)), ids))
    raw = np.ascontiguousarray(rows[order]).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, group = np.unique(raw, return_inverse=True)
    by_group = np.lexsort((np.arange(len(ids)), group))
    g, i = group[by_group], ids[order][by_group]
    new = np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])]          # a repeated row counts once
    by_group, g = by_group[new], g[new]
    nth = np.arange(len(g)) - np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(len(g)), 0))
    return order[np.sort(by_group[nth <= k])]


def _search(index: Callable, k: int, dtype):
    """index(ids, rows, k) gives search(query ids, query rows) -> (query
    number, id, score) arrays; ids come in ascending order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, rows, search = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(lo, hi - lo)
                if keys[lo] >> 1 != block:
                    block, ids, rows, search = keys[lo] >> 1, [], [], None
                part_ids, part_rows = part.column(2).to_numpy(), matrix(part.column(3), dtype)
                if not keys[lo] & 1:
                    ids.append(part_ids)
                    rows.append(part_rows)
                    continue
                if search is None:
                    if not ids:
                        continue
                    all_ids, all_rows = np.concatenate(ids), np.concatenate(rows)
                    kept = few_of_each(all_ids, all_rows, k)
                    # an id with several vectors may fill several of the best places
                    several = int(np.unique(all_ids[kept], return_counts=True)[1].max())
                    search, ids, rows = index(all_ids[kept], all_rows[kept], k * several), [], []
                q, found, score = search(part_ids, part_rows)
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(part_ids[q]), pa.array(found), pa.array(score)],
                                                     names=["query_id", "vec_id", "score"])
    return run


def search_blocks(data: DataFrame, queries: DataFrame, k: int, index: Callable, score_type: str, dtype,
                  largest: bool, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) from clean (id, vec) tables."""
    spark = data.sparkSession
    n = data.count()
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block_rows), min(cores, -(-n // SPREAD_ROWS)))

    def block(number: Column) -> Column:
        return F.size("vec").cast("long") * F.lit(blocks) + number

    rows = (data.select(block(F.pmod(F.xxhash64("id"), F.lit(blocks))).alias("block"), F.lit(0).alias("kind"), "id", "vec")
            .unionByName(queries.dropDuplicates(["id", "vec"]).select(
                "id", "vec", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
                .select(block(F.col("b")).alias("block"), F.lit(1).alias("kind"), "id", "vec")))
    dealt = rows.repartition("block").sortWithinPartitions("block", "kind", "id")
    found = dealt.mapInArrow(_search(index, k, dtype), f"query_id long, vec_id long, score {score_type}")
    # several vectors of one id: the best of them counts
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg((F.max if largest else F.min)("score").alias("score"))
    best = F.desc("score") if largest else F.asc("score")
    nth = Window.partitionBy("query_id").orderBy(best, "vec_id")
    return (found.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
