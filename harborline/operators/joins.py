"""Joins in which missing keys match each other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets that rows with a missing key are dealt over.
MISSING_BUCKETS = 32


def right_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], buckets: int = MISSING_BUCKETS
) -> DataFrame:
    """All rows of ``right`` with the columns of ``left`` where the keys agree, missing ones with missing ones.

    A key that many rows lack is one key to a shuffle. So the rows of ``right`` that lack any are dealt over ``buckets``
    by their content and partition, and those of ``left`` go to every bucket; each row of ``right`` still meets
    every match once. ``left`` should have few rows for each missing key, such as one after a sum. Other hot keys
    are left to adaptive execution.
    """
    a = left.select(F.struct(*left.columns).alias("a"))
    b = right.select(F.struct(*right.columns).alias("b"))

    def lacks(side: str):
        return reduce(or_, [F.col(side).getField(k).isNull() for k in keys])

    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    a = a.withColumn("left_bucket", F.explode(F.when(lacks("a"), every).otherwise(F.array(F.lit(0)))))
    # The same after a task is run again, whatever the order of its rows.
    dealt = F.pmod(F.spark_partition_id() + F.xxhash64("b"), F.lit(buckets)).cast("int")
    b = b.withColumn("right_bucket", F.when(lacks("b"), dealt).otherwise(0))
    test = F.col("left_bucket") == F.col("right_bucket")
    for key in keys:
        test = test & F.col("a").getField(key).eqNullSafe(F.col("b").getField(key))
    return a.join(b, test, "right").select(
        *(F.col("b").getField(key).alias(key) for key in keys),
        *(F.col("a").getField(c).alias(c) for c in left.columns if c not in keys),
        *(F.col("b").getField(c).alias(c) for c in right.columns if c not in keys),
    )
