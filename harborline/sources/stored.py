"""Trip tables stored by ticket, so that lines and headers meet where they lie."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from harborline.session import new_folder

#: Rows of a table that go to one bucket.
BUCKET_ROWS = 4_000_000


def store_by_ticket(
    df: DataFrame,
    name: str,
    ticket: str,
    buckets: int,
    sums: Mapping[str, Column] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Writes a frame once as a table of ``buckets`` files, dealt by ticket and sorted by it; the stored table.

    Tables with as many buckets meet on their ticket, and group by it, without moving a row, whatever the size of either:
    a bucket of one holds the tickets of the same bucket of the other. ``sums``, for each of ``keys`` and ticket, are taken
    on the way: a ticket with very many lines leaves each task as few rows, and its bucket stays small. Lines
    that are looked at one by one are stored without.
    """
    if sums is not None:
        df = df.groupBy(ticket, *keys).agg(*(total.alias(n) for n, total in sums.items()))
    spark = df.sparkSession
    (
        df.repartition(buckets, ticket)
        .write.bucketBy(buckets, ticket)
        .sortBy(ticket)
        .option("path", new_folder(spark, name))
        .format("parquet")
        .mode("overwrite")
        .saveAsTable(name)
    )
    return spark.table(name)


def stored(spark: SparkSession, name: str) -> DataFrame | None:
    """A table stored before, if the session's catalog has it."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def buckets_for(rows: int, at_least: int = 1) -> int:
    """Buckets of at most BUCKET_ROWS rows, a power of two, so that numbers of buckets always divide one another."""
    wanted = max(at_least, -(-rows // BUCKET_ROWS))
    return 1 << (wanted - 1).bit_length()
