"""Helpers shared by the operators: tables, lineage, byte-bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.session import cut_lineage, new_folder

__all__ = ["BitSieve", "Sent", "cut_lineage", "offsets", "pieces", "stage_folder", "subset", "table", "text_or_empty", "unused"]

#: Text bytes that numpy works on at a time; a longer text is a piece of its own.
PIECE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_folder(spark: SparkSession) -> str:
    """A new folder, under the shared one, for tables that stages hand on."""
    return new_folder(spark, "stages")


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into slices of about `size` bytes of the column, so memory does not follow the batch."""
    rows = batch.num_rows
    if rows == 0:
        return
    array = batch.column(batch.schema.get_field_index(column))
    ends = offsets(array)
    start = 0
    while start < rows:
        stop = int(ends.searchsorted(ends[start] + size, side="right")) - 1
        stop = min(rows, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def offsets(array: pa.Array):
    """Byte offsets of a string or binary array, one more than it has rows."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def subset(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: whatever else the input carries cannot clash with the operator's own."""
    return df.select(*[df[name] for name in names])


def unused(df: DataFrame, name: str) -> str:
    """The name, or the shortest longer one, that no column of df has in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Sent:
    """A broadcast that carries its classes along, so that tasks need not import this package."""

    def __init__(self, spark: SparkSession, value):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self) -> dict:
        return {"held": self.held, "_value": None}

    def drop(self) -> None:
        """Frees it everywhere; nothing may read it any more."""
        self.held.destroy()

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self.held.value)
        return self._value


class BitSieve:
    """A bit for each of at most 2**BITS values of a hash column (long): passes all keys, and few others.

    Only ever used to leave out rows early that a later join would leave out, so a full sieve costs time, not
    rows. It goes to the tasks as a broadcast: about 64 bits for each key, and never more than 2**BITS bits.
    """

    BITS = 27

    def __init__(self, keys: DataFrame, column: str):
        place = F.shiftrightunsigned(F.col(column), 64 - self.BITS)
        words = (
            keys.select(place.alias("place"))
            .select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
            .groupBy("word")
            .agg(F.bit_or("bit").alias("bits"))
        )
        table = words.toArrow()
        word = table["word"].to_numpy().astype(np.int64)
        bits = table["bits"].to_numpy().astype(np.int64).view(np.uint64)
        self.count = count = int(np.bitwise_count(bits).sum())  # places that keys take
        self.bits = min(self.BITS, max(12, (64 * count).bit_length()))
        sieve = np.zeros(1 << (self.bits - 6), np.uint64)
        for bit in range(64):  # fewer bits: neighbouring places become one
            places = (word[(bits >> np.uint64(bit) & np.uint64(1)) > 0] * 64 + bit) >> (self.BITS - self.bits)
            np.bitwise_or.at(sieve, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
        self.held = keys.sparkSession.sparkContext.broadcast(sieve)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        """Which of some hashes (long, as in the key column) may be keys."""
        place = hashes.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.held.value[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
