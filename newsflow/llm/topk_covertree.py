"""Exact top-k inner products by a dual-tree search over cover trees.

The rows of a block and the queries of an Arrow batch are both put into a
cover tree: a node's points lie within its covering radius of its centre,
and its children are a net of the node at a smaller radius (``BASE`` times
smaller per level), down to leaves of ``LEAF`` points. For a query node with
centre p and radius a and a data node with centre c and radius b no inner
product of a query and a row exceeds

    <p, c> + a |c| + b |p| + a b,

so a pair of nodes is pruned when that bound lies below the worst kth score
of the query node's group (equal bounds are kept: ties go to the smaller
id). Pairs are visited in order of falling bound, so good scores are found
early; a pair of leaves is a matrix product. The bound is computed in double
precision with a margin for its rounding; the scores are exact integers.

Blocks, their sizes and the merge over blocks are described in ``vectors``.

Components are floor(scale * x) of the doubles x. Defined results: vectors
that are NULL, empty or hold NULL or non-finite components take no part,
neither do NULL ids; a vector that quantises to zero does; rows repeated as
a whole count once; of several vectors with one id the best counts; a query
never finds its own id; components beyond 2^31 after scaling raise an error
rather than give a wrong score; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import is_finite, search_blocks

BASE = 1.3
LEAF = 256
QUERY_LEAF = 64
LOWEST = -(1 << 62)


class CoverTree:
    """Points in tree order with flat arrays of nodes."""

    def __init__(self, rows: np.ndarray, leaf: int):
        self.order = np.arange(len(rows))
        self.rows = rows.astype(np.float64)
        self.centre, self.radius, self.span, self.children = [], [], [], []
        if len(rows):
            self._build(leaf)
        self.centre = np.array(self.centre).reshape(len(self.span), rows.shape[1])
        self.radius = np.array(self.radius)
        self.norm = np.sqrt((self.centre ** 2).sum(axis=1))
        self.rows = self.rows[self.order]

    def _node(self, lo: int, hi: int, centre: np.ndarray, far: float) -> int:
        self.centre.append(centre)
        self.radius.append(far)
        self.span.append((lo, hi))
        self.children.append([])
        return len(self.span) - 1

    def _distances(self, members: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.rows[members] - centre) ** 2).sum(axis=1))

    def _build(self, leaf: int) -> None:
        centre = self.rows[0]
        root = self._node(0, len(self.rows), centre, float(self._distances(self.order, centre).max()))
        todo = [(root, self.radius[root])]
        while todo:
            node, scale = todo.pop()
            lo, hi = self.span[node]
            if hi - lo <= leaf or self.radius[node] == 0:
                continue
            members, inner = self.order[lo:hi].copy(), min(scale, self.radius[node]) / BASE
            rest, parts = members, []
            far = self._distances(rest, self.centre[node])
            alone = []  # net points that cover only themselves make leaves together
            while len(rest):
                pick = int(far.argmin()) if not parts and not alone else int(far.argmax())
                c = self.rows[rest[pick]]
                d = self._distances(rest, c)
                near = d <= inner
                if near.sum() > 1:
                    parts.append((rest[near], c, float(d[near].max())))
                else:
                    alone.append(int(rest[pick]))
                rest, far = rest[~near], np.minimum(far, d)[~near]
                if len(parts) + len(alone) > FAN:  # a wider net would be flat: the rest forms leaves
                    alone += rest.tolist()
                    break
            for at in range(0, len(alone), leaf):
                group = np.array(alone[at:at + leaf])
                c = self.rows[group].mean(axis=0)
                parts.append((group, c, float(self._distances(group, c).max())))
            for group, c, reach in parts:
                self.order[lo:lo + len(group)] = group
                child = self._node(lo, lo + len(group), c, reach)
                self.children[node].append(child)
                todo.append((child, inner))
                lo += len(group)


FAN = 64


class DualSearch:
    """The best ``k`` of the data tree for every query of a query tree."""

    def __init__(self, data: CoverTree, data_rows: np.ndarray, ids: np.ndarray, k: int):
        self.data, self.k = data, k
        self.rows = data_rows[data.order]     # integers, in tree order
        self.ids = ids[data.order]
        self.place = (len(ids) - 1 - data.order).astype(np.int64)  # larger for smaller ids
        self.bits = max(1, int(len(ids)).bit_length())
        self.most = int(np.abs(self.rows).max(initial=0))
        self.sorted_ids = ids

    def run(self, query_ids: np.ndarray, queries: np.ndarray):
        size = queries.shape[1] * self.most * int(np.abs(queries).max(initial=0))
        # a score and a place share one sortable integer; wide ones are Python's
        kind = np.int64 if size < 1 << (60 - self.bits) else object
        exact_doubles = size < 1 << 52
        tree = CoverTree(queries, QUERY_LEAF)
        rows, own = queries[tree.order], query_ids[tree.order]
        best = np.full((len(rows), self.k), LOWEST if kind is np.int64 else -(1 << 200), dtype=kind)
        # the bound of a node pair is compared with the worst kth score of the group
        worst = np.full(len(rows), -np.inf)
        d, todo = self.data, [(np.inf, 0, 0)]
        d_rows = self.rows.astype(np.float64) if exact_doubles else self.rows.astype(object)
        q_rows = rows.astype(np.float64) if exact_doubles else rows.astype(object)

        def bounds(qs: list[int], ds: list[int]) -> np.ndarray:
            a, b = tree.radius[qs][:, None], d.radius[ds][None]
            top = tree.centre[qs] @ d.centre[ds].T + a * d.norm[ds] + b * tree.norm[qs][:, None] + a * b
            return top + 1e-9 * (np.abs(top) + 1)

        while todo:
            top, qn, dn = todo.pop()
            ql, qh = tree.span[qn]
            if top < worst[ql:qh].min():
                continue
            if tree.children[qn] or d.children[dn]:
                qs, ds = tree.children[qn] or [qn], d.children[dn] or [dn]
                b = bounds(qs, ds)
                low = np.array([worst[slice(*tree.span[q])].min() for q in qs])
                at = np.argwhere(b >= low[:, None])
                at = at[np.argsort(b[at[:, 0], at[:, 1]], kind="stable")]  # the largest bound is popped first
                todo += [(float(b[i, j]), qs[i], ds[j]) for i, j in at.tolist()]
                continue
            dl, dh = d.span[dn]
            score = q_rows[ql:qh] @ d_rows[dl:dh].T
            better = np.flatnonzero((score.max(axis=1) >= worst[ql:qh]))
            if not len(better):
                continue
            score = score[better].astype(kind)
            keys = score * (1 << self.bits) + self.place[dl:dh].astype(kind)
            keys[own[ql:qh][better][:, None] == self.ids[dl:dh][None]] = best.dtype.type(LOWEST) if kind is np.int64 else -(1 << 200)
            merged = np.concatenate([best[ql:qh][better], keys], axis=1)
            if kind is np.int64 and merged.shape[1] > self.k:
                merged = -np.partition(-merged, self.k - 1, axis=1)
            else:
                merged = -np.sort(-merged, axis=1)
            best[ql + better] = merged[:, :self.k]
            kth = best[ql + better].min(axis=1)
            worst[ql + better] = np.where(kth > LOWEST, (kth >> self.bits if kind is np.int64 else
                                                         np.array([x >> self.bits for x in kth], dtype=object)), -np.inf).astype(float)
        found = best > LOWEST if kind is np.int64 else best > -(1 << 199)
        q, _ = np.nonzero(found)
        keys = best[found]
        place = (keys & ((1 << self.bits) - 1)).astype(np.int64)
        score = (keys >> self.bits).astype(np.int64)
        return tree.order[q], self.sorted_ids[len(self.sorted_ids) - 1 - place], score


def _index(ids: np.ndarray, rows: np.ndarray, k: int):
    tree = CoverTree(rows, LEAF)
    return DualSearch(tree, rows, ids, k).run


def quantised(vec: str, scale: float) -> Column:
    return F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id",
                 vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest integer inner
    product for each row for which ``is_query`` (a condition on ``id``) holds."""
    clean = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
             .where(F.col("id").isNotNull()).where(is_finite("vec"))
             .select("id", quantised("vec", scale).alias("vec")))
    wide = F.exists("vec", lambda x: F.abs(x) > (1 << 31))
    clean = clean.withColumn("vec", F.when(wide, F.raise_error(F.lit("a component is beyond 2^31"))).otherwise(F.col("vec")))
    return search_blocks(clean, clean.where(is_query), k, _index, "long", np.int64, largest=True)
