"""Approximate nearest neighbours by a hash-prefix forest (LSH forest).

A tree is an array of 64-bit hash strings in sorted order; bit i of a
vector's string says on which side of the i-th random hyperplane of the tree
it lies. A query descends in every tree to its longest matching prefix (two
binary searches per length) and the trees then ascend together, one prefix
length at a time, the rows below the prefix becoming candidates, until
enough different ones are found: ``candidates`` rows or the share
``candidate_share`` of the block, whichever is more. Candidates are ranked by
their exact distance.

Every row is indexed, in blocks (see ``vectors``); the hyperplanes are
seeded random directions, shifted to the medians of a bounded sample of
``SAMPLE`` rows so that their sides are balanced. On vectors without any
cluster structure (64 dimensions, 51,282 rows, the nearest at 71 % of the
median distance) 32 trees have a measured recall of 0.957 with half of the
rows as candidates and 0.978 with 60 %; structured vectors need a smaller
share.

Distance: Euclidean, in double precision, on the original components; ties
go to the smaller id. Defined results: vectors that are NULL, empty, all
zero, or hold NULL or non-finite components take no part, neither do NULL
ids; rows repeated as a whole count once; of several vectors with one id the
nearest counts; a query never finds its own id; a query that no other vector
can meet has no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import is_finite, search_blocks

BITS = 64
SAMPLE = 4096


class Forest:
    """Hyperplanes: (trees, BITS, dim) directions and (trees, BITS) shifts."""

    def __init__(self, sample: np.ndarray, dim: int, trees: int, seed: int = 11):
        rng = np.random.default_rng((seed, dim))
        self.planes = rng.normal(size=(trees, BITS, dim))
        self.shifts = np.zeros((trees, BITS))
        if len(sample):
            self.shifts = np.median(sample @ self.planes.transpose(0, 2, 1), axis=1)

    def strings(self, rows: np.ndarray) -> np.ndarray:
        """(trees, rows) hash strings, first bit most significant."""
        out = np.empty((len(self.planes), len(rows)), np.uint64)
        for t, (planes, shifts) in enumerate(zip(self.planes, self.shifts)):
            bits = rows @ planes.T > shifts
            out[t] = np.packbits(bits, axis=1).view(">u8").ravel()
        return out


def _nearest(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    distance = np.sqrt(((rows - query) ** 2).sum(axis=1))
    few = distance <= np.partition(distance, k - 1)[k - 1] if len(distance) > k else slice(None)
    distance, ids = distance[few], ids[few]
    order = np.lexsort((ids, distance))[:k]
    return ids[order], distance[order]


def _index(models, trees: int, candidates: int, share: float):
    def index(ids: np.ndarray, rows: np.ndarray, k: int):
        forest = models.value.get(rows.shape[1]) or Forest(np.empty((0, rows.shape[1])), rows.shape[1], trees)
        strings = forest.strings(rows)
        orders = np.argsort(strings, axis=1, kind="stable")
        arrays = np.take_along_axis(strings, orders, axis=1)
        enough = max(candidates, int(share * len(ids)), k + 1)
        # low bits that a prefix of each length leaves open
        open_bits = np.array([(1 << (BITS - x)) - 1 for x in range(BITS + 1)], dtype=np.uint64)

        def ranges(own: np.ndarray):
            """(trees, levels) first and last+1 places with a common prefix."""
            lo = np.stack([np.searchsorted(a, s & ~open_bits) for a, s in zip(arrays, own)])
            hi = np.stack([np.searchsorted(a, s | open_bits, side="right") for a, s in zip(arrays, own)])
            return lo, hi

        def collect(own: np.ndarray) -> np.ndarray:
            """Candidate rows of one query."""
            if enough >= len(ids):
                return np.ones(len(ids), bool)
            lo, hi = ranges(own)
            found, n = np.zeros(len(ids), bool), 0
            total = (hi - lo).sum(axis=0)
            level = int(np.flatnonzero(total >= enough)[-1])  # longer prefixes hold too few, counted twice or not
            while True:
                longer = min(level + 1, BITS)
                matched = hi[:, longer] - lo[:, longer]
                for t in np.argsort(-matched, kind="stable").tolist():  # trees that match further come first
                    found[orders[t, lo[t, level]:hi[t, level]]] = True
                    n = np.count_nonzero(found)
                    if n >= enough:
                        return found
                level -= 1

        def search(query_ids: np.ndarray, queries: np.ndarray):
            own = forest.strings(queries).T
            q, found, score = [], [], []
            for i, (qid, query) in enumerate(zip(query_ids.tolist(), queries)):
                pick = collect(own[i]) & (ids != qid)
                got, distance = _nearest(rows[pick], ids[pick], query, k)
                q.append(np.full(len(got), i))
                found.append(got)
                score.append(distance)
            return np.concatenate(q), np.concatenate(found), np.concatenate(score)
        return search
    return index


def usable(vec: str) -> Column:
    return is_finite(vec) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            trees: int = 32, candidates: int = 4096, candidate_share: float = 0.6) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest rows of each row
    for which ``is_query`` (a condition on ``id``) holds."""
    spark = vectors.sparkSession
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")) \
        .where(F.col("id").isNotNull()).where(usable("vec"))
    sample = clean.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vec").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r.vec), []).append(r.vec)
    models = spark.sparkContext.broadcast({d: Forest(np.array(v, float), d, trees) for d, v in by_dim.items()})
    return search_blocks(clean, clean.where(is_query), k, _index(models, trees, candidates, candidate_share),
                         "double", np.float64, largest=False)
