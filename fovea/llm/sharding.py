"""Contiguous byte-balanced shards from global prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import saved

SHARDS = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every row to one of ``shards`` contiguous runs of near-equal bytes.

    The rows are dealt out by range of (id, checksum, row number of the scan),
    each part gives its total of bytes and of rows, the running sums of these
    few totals are the offsets of the parts, and a running sum inside each part
    completes the global prefix sum. A row goes to the shard in which the
    middle of its bytes falls: ``floor((before + size / 2) * shards / total)``.
    A shard is thus off its target by at most one row's size.

    The offsets table has one row per shuffle partition and the table of shard
    starts one per shard; only these two are broadcast.

    Returns id, size, text_crc32, shard, slot (position in the shard, from 0).
    Null text: size 1, checksum 0. Empty input: no rows. Repeated rows are
    separate rows; the scan's row number keeps a repeated key from filling one
    part. Null ids come first. Other columns are ignored.
    """
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("crc"),
        F.monotonically_increasing_id().alias("tie"),
    )
    parts = saved(slim.repartitionByRange("id", "crc", "tie").withColumn("part", F.spark_partition_id()), "shard-parts")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("total"),
        )
    )
    order = Window.partitionBy("part").orderBy("id", "crc", "tie")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        parts.withColumns({"upto": F.sum("size").over(running), "nth": F.row_number().over(order)})
        .join(F.broadcast(offsets), "part")
        .select(
            "id",
            "size",
            "crc",
            F.least(F.expr(f"((bytes_before + upto - size) * 2 + size) * {shards} div (total * 2)"), F.lit(shards - 1)).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("at"),
        )
    )
    starts = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") - F.col("first")).alias("slot")
    )
