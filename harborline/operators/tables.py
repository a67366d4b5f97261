"""Parameter tables declared in code, and frames put under each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARROW = {
    T.StringType(): pa.string(),
    T.IntegerType(): pa.int32(),
    T.DoubleType(): pa.float64(),
}


def parameter_table(spark: SparkSession, schema: T.StructType, rows: Sequence[tuple]) -> DataFrame:
    """A local relation of any length. Its size is known exactly, so a join broadcasts it
    while it is below the session's threshold and shuffles it beyond."""
    columns = [
        pa.array([row[i] for row in rows], type=_ARROW[field.dataType])
        for i, field in enumerate(schema.fields)
    ]
    table = pa.table(columns, names=schema.names)
    return spark.createDataFrame(table, schema=schema)


def append(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, columns matched by name; a column that a frame lacks is missing in its rows. Rows that
    repeat stay, within a frame and between frames."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@dataclass(frozen=True)
class Subset:
    """Rows of a frame that meet a test, with columns of their own."""

    test: Column
    columns: Mapping[str, Column | str]


def append_subsets(df: DataFrame, subsets: Sequence[Subset]) -> DataFrame:
    """Subsets of one frame put under each other by ``append``'s rules, from one pass over it.

    A row comes out once for each subset whose test it meets; an unknown test is not met. Each row carries
    its subsets in an array, so the frame is scanned once however many there are, where a union of filtered
    frames scans it for each.
    """
    selected = [df.select(*(_column(c).alias(n) for n, c in s.columns.items())) for s in subsets]
    types: dict[str, T.DataType] = {}
    for frame in selected:
        for field in frame.schema.fields:
            if types.setdefault(field.name, field.dataType) != field.dataType:
                raise ValueError(f"{field.name} is {types[field.name]} in one subset and {field.dataType} in another")

    def row(subset: Subset) -> Column:
        return F.struct(
            *(
                (_column(subset.columns[n]) if n in subset.columns else F.lit(None).cast(kind)).alias(n)
                for n, kind in types.items()
            )
        )

    rows = F.array_compact(F.array(*(F.when(s.test, row(s)) for s in subsets)))
    return df.select(F.explode(rows).alias("row")).select("row.*")


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
