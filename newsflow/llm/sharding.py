"""Byte-balanced contiguous sharding from global prefix sums.

Every document gets its place in one global order (doc_id first); the byte
prefix sum before it decides its shard: the 0..total axis is cut at
``n_shards`` equal targets and a document belongs to the interval that holds
the middle of its own byte range, so a shard is a contiguous run of the
order whose bytes differ from the target by less than one document.

The prefix sum is built from per-partition totals: rows are dealt by range,
each partition sums itself, the partition totals (one row per partition) are
accumulated, and a running sum inside each partition is added to its offset.
Only DataFrame functions are used.

Defined results: a NULL text counts ``overhead`` bytes and has CRC 0; equal
or NULL ids are ordered by CRC and then by a seeded random salt, which is
also part of the range key, so an id that a third of all rows share is still
split over partitions and shards; an empty table gives an empty result;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

LAW = "bytes"


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id",
                   text_col: str = "text", overhead: int = 16, seed: int = 7) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) per document.

    size: UTF-8 bytes of the text plus ``overhead``; slot: position inside
    the shard, gapless from 0; grown_shard: NULL, the ``bytes`` law makes no
    promise about a larger shard count."""
    order = [id_col, "text_crc32", "_salt"]
    base = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(text_col), F.lit(0)).cast("long").alias("text_crc32"),
        F.rand(seed).alias("_salt"))
    # stored once: the partition a row fell into must not change between uses
    dealt = materialize(base.repartitionByRange(*order)
                        .withColumn("_part", F.spark_partition_id()), "shard-dealt")

    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (dealt.groupBy("_part").agg(F.sum("size").alias("_b"), F.count(F.lit(1)).alias("_n"))
               .select("_part",
                       F.coalesce(F.sum("_b").over(upto), F.lit(0)).alias("_bytes_before"),
                       F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_rows_before"),
                       F.sum("_b").over(whole).alias("_total")))

    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (dealt
              .withColumn("_end", F.sum("size").over(inside))
              .withColumn("_row", F.row_number().over(inside))
              .join(F.broadcast(offsets), "_part"))  # one row per partition
    # twice the middle of the document's byte range, on an axis of twice the total
    placed = placed.select(
        id_col, "size", "text_crc32",
        F.least(F.expr(f"(2 * (_bytes_before + _end) - size) * {n_shards} div (2 * _total)").cast("int"),
                F.lit(n_shards - 1)).alias("shard"),
        (F.col("_rows_before") + F.col("_row")).alias("_index"))
    firsts = placed.groupBy("shard").agg(F.min("_index").alias("_first"))  # at most n_shards rows
    return (placed.join(F.broadcast(firsts), "shard")
            .select(id_col, "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                    (F.col("_index") - F.col("_first")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
