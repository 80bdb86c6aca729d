"""Sharding: contiguous shards of near-equal bytes from global prefix sums.

Rows are put in order of id by a range partitioning; each partition's byte and
row totals give its offset, a running sum inside the partition gives every row
its global first byte, and the byte axis is cut at equal targets. Only one row
a partition is gathered anywhere.

Defined results: a null text counts one byte; a null id sorts first; rows with
equal ids follow each other in the order of their text checksum; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import stage_table


def _placed(docs: DataFrame, n_shards: int, id_col: str, text_col: str, more: tuple[str, ...] = ()) -> DataFrame:
    """``shard_documents`` with the columns ``more`` of the rows as a struct ``doc``, if there are any."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        *([F.struct(*more).alias("doc")] if more else []),
    ).withColumn("tie", F.rand(11))  # equal rows, however many, spread over partitions
    order = ["doc_id", "text_crc32", "size", "tie"]
    rows = stage_table(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranged")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    kept = ["doc_id", "size", "text_crc32", *(["doc"] if more else [])]
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = rows.groupBy("part").agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
    parts = parts.select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_size").over(whole).alias("total"),
    )
    within = Window.partitionBy("part").orderBy(*order)
    placed = (
        rows.withColumn("end_in_part", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("row_in_part", F.row_number().over(within))
        .join(F.broadcast(parts), "part")  # as many rows as the range partitioning has partitions
        .withColumn("first_byte", F.col("bytes_before") + F.col("end_in_part") - F.col("size"))
        .withColumn("row", F.col("rows_before") + F.col("row_in_part") - 1)
        .withColumn("shard", F.expr(f"cast((first_byte * {int(n_shards)}) div total as int)"))
        .select(*kept, "shard", "row")
    )
    placed = stage_table(placed, "placed")
    starts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(starts), "shard").select(
        *kept, "shard", (F.col("row") - F.col("first_row")).alias("slot")
    )


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slot counts from 0 within the shard, in order of id."""
    return _placed(docs, n_shards, id_col, text_col)


def write_shards(docs: DataFrame, path: str, n_shards: int = 8) -> None:
    """Write the documents as one folder a shard: every row, in the shard that it is placed in."""
    _placed(docs, n_shards, "doc_id", "text", tuple(docs.columns)).select("doc.*", "shard").write.partitionBy("shard").parquet(path)
