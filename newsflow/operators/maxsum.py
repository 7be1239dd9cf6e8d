"""Max-sum selection: the ``k`` items of a small list that are least alike.

Choosing 10 of 20 has 184,756 outcomes. The list is cut in half, the cost of
every subset of each half is tabulated, and a whole choice is a subset of the
left half of size s with one of the right half of size k - s: its cost is both
entries and what lies across, a product of two small matrices. All choices of
one split are priced at once, so a document is a few matrix products instead
of a search, and the answer is exact.

Similarities are whole numbers (a millionth of the Jaccard coefficient of the
items' tokens), so sums compare exactly and ties are the same everywhere.
Documents are independent rows: no shuffle, bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

SCALE = 1_000_000
MOST = 24      # items: 2 ** 12 subsets of a half


def similarities(items: list[list[str]]) -> np.ndarray:
    """Jaccard coefficients of the items' tokens in millionths, rounded half
    up; two items without tokens are not alike."""
    sets = [set(x) for x in items]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for i, j in combinations(range(len(sets)), 2):
        union = len(sets[i] | sets[j])
        out[i, j] = out[j, i] = (2 * SCALE * len(sets[i] & sets[j]) + union) // (2 * union) if union else 0
    return out


@lru_cache(maxsize=512)
def _subsets(n: int, k: int) -> np.ndarray:
    """Subsets of size k of n places as rows of 0 and 1, in order."""
    rows = list(combinations(range(n), k))
    out = np.zeros((len(rows), n))
    for r, places in enumerate(rows):
        out[r, list(places)] = 1
    return out


def _inner(x: np.ndarray, alike: np.ndarray) -> np.ndarray:
    return ((x @ alike) * x).sum(axis=1) / 2


def choose(alike: np.ndarray, k: int) -> tuple[list[int], int]:
    """(places in order, sum) of the k places with the least sum of pairwise
    similarities; of equal sums the places that come first."""
    n = len(alike)
    if n > MOST:
        raise ValueError(f"more than {MOST} items")
    if k >= n:
        return list(range(n)), int(np.triu(alike, 1).sum())
    alike = alike.astype(np.float64)      # whole numbers far below 2 ** 53
    h = n // 2
    best: tuple[float, list[int]] | None = None
    for s in range(max(0, k - (n - h)), min(h, k) + 1):
        left, right = _subsets(h, s), _subsets(n - h, k - s)
        cost = (_inner(left, alike[:h, :h])[:, None] + _inner(right, alike[h:, h:])[None, :]
                + left @ alike[:h, h:] @ right.T)
        # row by row the choices are in order, so the first least one comes first
        at = int(cost.argmin())
        a, b = divmod(at, len(right))
        found = float(cost[a, b]), np.flatnonzero(left[a]).tolist() + (np.flatnonzero(right[b]) + h).tolist()
        best = found if best is None else min(best, found)
    return best[1], round(best[0])


def least_alike(df: DataFrame, items: Column, k: int, places_col: str, sum_col: str) -> DataFrame:
    """Adds the chosen places (from 0) of ``items`` (an array of token
    arrays) and their sum of similarities as a fraction."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [choose(similarities(x or []), k) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([c[0] for c in chosen], pa.list_(pa.int32())),
                 pa.array([c[1] / SCALE for c in chosen], pa.float64())],
                names=[*batch.schema.names[:-1], places_col, sum_col])

    schema = T.StructType([*df.schema.fields, T.StructField(places_col, T.ArrayType(T.IntegerType())),
                           T.StructField(sum_col, T.DoubleType())])
    return df.select("*", items.alias("_items")).mapInArrow(run, schema)
