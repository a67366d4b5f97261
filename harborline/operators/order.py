"""Rows in order and their numbers, without bringing them into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.session import cut_lineage

#: The low bits of monotonically_increasing_id, which count the rows of a partition.
ROW_BITS = 33
#: Partitions whose counts are added up side by side.
BLOCK_PARTITIONS = 1024


def _ranged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row as a struct in range partitions by the keys, missing ones last, equal keys in the order they came.

    The partition a row came from takes part in the ranges, so a key that a third of the rows share is spread over many
    of them. Its place in there does not, so that a task run again sends every row where it went before.
    """
    rows = df.select(
        F.struct("*").alias("row"),
        F.spark_partition_id().alias("from"),
        F.monotonically_increasing_id().alias("came"),
    )
    order = [F.col("row").getField(k).asc_nulls_last() for k in keys] + [F.col("from").asc()]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("came").asc())


def in_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows sorted by the keys over all partitions: written, the files in order hold the rows in order."""
    return _ranged(df, keys).select("row.*")


def sums_before(counts: DataFrame, key: str, value: str, block: int = BLOCK_PARTITIONS) -> DataFrame:
    """key and before: the sum of the values at smaller keys, for keys that number few rows from 0.

    Prefix sums inside blocks of neighbouring keys, and each block's total added to the blocks behind it.
    """
    blocked = counts.withColumn("block", F.expr(f"{key} div {block}"))
    inside = Window.partitionBy("block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    within = blocked.select(key, "block", F.coalesce(F.sum(value).over(inside), F.lit(0)).alias("within"))
    last = blocked.agg(F.max("block")).scalar()
    totals = blocked.groupBy("block").agg(F.sum(value).alias("total")).where(F.col("block") < last)
    behind = totals.select(F.explode(F.sequence(F.col("block") + 1, last)).alias("block"), "total")
    blocks = behind.groupBy("block").agg(F.sum("total").alias("ahead"))
    joined = within.join(blocks, "block", "left")
    return joined.select(key, (F.col("within") + F.coalesce("ahead", F.lit(0))).alias("before"))


def row_numbered(df: DataFrame, keys: Sequence[str], name: str = "ROW") -> DataFrame:
    """Each row with its place (long, from 1) in the order of the keys, missing ones last, and in that order.

    The rows are range-partitioned and sorted once and written to the shared folder, so that one and the same
    layout is counted and numbered, also after an executor is lost. The counts of its partitions are added up, and
    each partition numbers its own rows from there. The sums are one row for each partition; that many rows
    are broadcast, so rows stay where and in the order they are.
    """
    placed = cut_lineage(
        _ranged(df, keys).select(
            "row",
            F.spark_partition_id().cast("long").alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("at"),
        )
    )
    before = sums_before(placed.groupBy("part").agg(F.count("*").alias("n")), "part", "n")
    place = (F.col("before") + F.col("at") + 1).alias(name)
    return placed.join(F.broadcast(before), "part").select("row.*", place)
