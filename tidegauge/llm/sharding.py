"""Balanced contiguous shards by a global prefix sum.

Rows are range-partitioned by id, each partition's total is summed, totals are accumulated over the
partitions (one row each), and every row's place on the line of all bytes is its partition's start
plus a running sum inside the partition. Cutting the line at equal targets gives shards that are
contiguous in id order and near equal in bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut


def shard(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, start_byte.

    Size is the text's UTF-8 bytes plus 1; a null text has size 1 and the CRC of no bytes (0). A row
    belongs to the shard in which the middle of its bytes falls, so a very long text makes one shard
    larger by at most half of itself. Null ids come last; ties in id are ordered by CRC and size, and
    rows equal in all three are interchangeable. Other columns are ignored. No rows give no rows.
    """
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    # The bounds of a range partitioning come from a sample of its own, so the partition numbers are fixed by writing them.
    laid = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))

    # One row a partition: its number of rows is the number of partitions, whatever the data.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        laid.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("part_byte"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_row"),
            F.sum("bytes").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
        )
    )
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        laid.join(F.broadcast(starts), "part")
        .withColumn("start_byte", F.col("part_byte") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("row", F.col("part_row") + F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1)
        .withColumn("shard", F.expr(f"cast(((2 * start_byte + size) * {n_shards}) div (2 * total) as int)"))
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "start_byte",
    )
