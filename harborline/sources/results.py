"""CSV results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.operators.order import in_order, row_numbered
from harborline.sources.tickets import MISSING_TEXT

ROW_NAME = "ROW"


def fixed_notation(name: str, digits: int = 12) -> Column:
    """A double as text without exponent and trailing zeros; infinities and NaN by name."""
    value = F.col(name)
    number = F.abs(value) < float("inf")
    text = F.when(number, value).cast(T.DecimalType(38, digits)).cast("string")
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return (
        F.when(F.isnan(value), "NaN")
        .when(value == float("inf"), "Inf")
        .when(value == float("-inf"), "-Inf")
        .otherwise(plain)
        .alias(name)
    )


def as_text(df: DataFrame, digits: int = 12) -> DataFrame:
    doubles = (T.DoubleType, T.FloatType)
    return df.select(
        *(
            fixed_notation(f.name, digits) if isinstance(f.dataType, doubles) else F.col(f.name)
            for f in df.schema.fields
        )
    )


def write_result(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    digits: int = 12,
    order: Sequence[str] | None = None,
    row_names: bool = False,
) -> None:
    """CSV with a header and NA for missing values, written in parallel: one file per partition.

    With ``order`` the files, by their numbers, hold the rows sorted by these columns, missing values last. With
    ``row_names`` a first column without a heading numbers the rows from 1 over all files, in that
    order or in the one the rows come in.
    """
    # Sorted and numbered as values, before numbers become text.
    if row_names:
        text = as_text(row_numbered(df, order or [], ROW_NAME), digits).select(ROW_NAME, *df.columns)
    else:
        text = as_text(in_order(df, order) if order else df, digits)
    if row_names:
        text = text.withColumnRenamed(ROW_NAME, "")
    text.write.mode(mode).csv(path, header=True, nullValue=MISSING_TEXT, emptyValue="")


def read_result(spark: SparkSession, path: str, schema: T.StructType, row_names: bool = False) -> DataFrame:
    """A written result with the column types of ``schema``, and each row's PLACE (long, from 1) over all files.

    ``schema`` has the columns as written; with ``row_names`` their numbers come first, as ROW (long). A place is
    that of the file by its number, of the stretch in the file and of the row in the stretch.
    """
    if row_names:
        schema = T.StructType([T.StructField(ROW_NAME, T.LongType()), *schema.fields])
    rows = (
        spark.read.schema(schema).option("header", True).option("enforceSchema", True)
        .option("nullValue", MISSING_TEXT).option("mode", "FAILFAST").csv(path)
    )
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    place = F.struct(number, F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return row_numbered(rows.select("*", place.alias("__place")), ["__place"], "PLACE").drop("__place")
