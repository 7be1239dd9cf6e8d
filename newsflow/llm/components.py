"""Connected components of a link table by alternating large and small stars.

Every round joins the links with the least neighbour of each node, keeps
connectivity and shortens paths; it ends when the links are stars around the
least node of each component (O(log^2) rounds). A round is one written table
under the shared checkpoint folder, so lineage stays short and a lost
executor costs one round at most. The least neighbour is a partial
aggregate and the join is a plain equi join, so a node with very many links
is pre-aggregated and its join partition can be split. The driver receives
one checksum row per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (hi, lo), hi > lo. Large star: every larger neighbour of a node
    is linked to the node's least neighbour (itself included). Small star:
    the node and its smaller neighbours are linked to the least of them."""
    if large:
        both = links.select(F.col("hi").alias("n"), F.col("lo").alias("v")).unionByName(
            links.select(F.col("lo").alias("n"), F.col("hi").alias("v")))
    else:
        both = links.select(F.col("hi").alias("n"), F.col("lo").alias("v"))
    least = both.groupBy("n").agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
    out = both.join(least, "n")
    if large:
        out = out.where("v > n").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = out.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(
            least.select(F.col("n").alias("hi"), F.col("m").alias("lo")))
    return out.where("hi > lo").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns): root is
    the least node of its component. Nodes without links are not given."""
    now = materialize(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                      .where("hi > lo").distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        now = materialize(_star(_star(now, large=True), large=False), "links")
    roots = now.select("lo").distinct()
    return (now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
            .unionByName(roots.select(F.col("lo").alias("node"), F.col("lo").alias("root"))))
