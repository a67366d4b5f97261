"""Contiguous shards of nearly equal bytes, by global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.common import cut_lineage, subset, text_or_empty

#: Bytes that each row has besides its text.
ROW_BYTES = 8


def row_size(text: str = "text") -> Column:
    return F.octet_length(text_or_empty(text)).cast("long") + F.lit(ROW_BYTES).cast("long")


def shard_by_bytes(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", ranges: int | None = None
) -> DataFrame:
    """Cuts the rows, in key order, into contiguous shards of equal bytes and numbers them in each.

    The rows are dealt into key ranges. Each range's total is summed on its own, the totals of the
    ranges before it are its offset, and a running sum inside the range completes the global prefix
    sum. A row belongs to the shard in whose target its middle byte falls, so the bytes of a shard
    miss the target by less than one row at either border. Texts are read once; key, size and
    checksum are all that moves.

    Null keys come first, a null text counts as empty, equal keys go by checksum, and rows equal in
    both are interchangeable. A key (or null) with more rows than a range should hold is dealt over
    several ranges by checksum. An empty table gives no rows. Other columns play no part.

    Returns key, size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in each shard).
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(
        subset(docs, key, text).select(
            F.col(key).cast("long").alias("k"), row_size(text).alias("size"), F.crc32(text_or_empty(text)).alias("crc")
        )
    )
    ordered = ("k", "crc", "size")
    # The ranges' bounds: `ranges` numbers, whatever the input.
    steps = [i / ranges for i in range(1, max(ranges, 2))]
    cuts = rows.agg(F.percentile_approx("k", steps, 100 * ranges)).first()[0]
    edges = F.array(*[F.lit(c).cast("long") for c in sorted(cuts or [0])])
    below = F.size(F.filter(edges, lambda e: e < F.col("k")))
    equal = F.size(F.filter(edges, lambda e: e == F.col("k")))
    portion = F.col("crc") / F.lit(float(2**32))
    dealt = rows.withColumn(
        "range",
        F.when(F.col("k").isNull(), F.floor(portion * ranges) - ranges)
        .otherwise(below + F.floor(portion * equal))
        .cast("int"),
    )
    # One row for each range from here: at most twice `ranges` rows meet in one task.
    totals = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("all_bytes"),
    )
    running = Window.partitionBy("range").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
    middle = "cast(2 * (bytes_before + upto) - size as decimal(38, 0))"
    placed = (
        dealt.withColumn("upto", F.sum("size").over(running))
        .withColumn("nth", F.row_number().over(Window.partitionBy("range").orderBy(*ordered)))
        .join(F.broadcast(offsets), "range")
        .withColumn("shard", F.least(F.expr(f"({middle} * {shards}) div (2 * all_bytes)"), F.lit(shards - 1)).cast("int"))
        .withColumn("place", F.col("rows_before") + F.col("nth") - 1)
    )
    begins = placed.groupBy("shard").agg(F.min("place").alias("begin"))  # one row for each shard
    return placed.join(F.broadcast(begins), "shard").select(
        F.col("k").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("place") - F.col("begin")).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes the documents as Parquet, one folder for each shard, with the columns shard and slot.

    Keys must be unique and not null, as a row is found by its key, and docs must have no such columns: a key that is
    null or comes twice stops the job before anything is written. Null and empty texts are rows like any other;
    an empty table gives an empty folder.
    """
    clash = {"shard", "slot"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"the documents have columns named {sorted(clash)} themselves")
    if docs.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(1).count():
        raise ValueError(f"{key} is null or repeated")
    docs.join(placed.select(key, "shard", "slot"), key).write.partitionBy("shard").parquet(path)
