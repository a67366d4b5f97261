"""Bycatch that comes with projected landings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.operators.tables import parameter_table

BIN_SCHEMA = T.StructType(
    [
        T.StructField("REGION", T.StringType(), False),
        T.StructField("BIN", T.StringType(), False),
        T.StructField("CATCH_SHARE", T.DoubleType(), False),
        T.StructField("DISCARD_RATIO", T.DoubleType(), False),
        T.StructField("MORTALITY", T.DoubleType(), False),
    ]
)


def bin_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Depth bins of each region: share of the catch, discard ratio, discard mortality."""
    return parameter_table(spark, BIN_SCHEMA, rows)


def bycatch_tons(
    projected: DataFrame, bins: DataFrame, region: str, columns: Mapping[str, str]
) -> DataFrame:
    """Tons of bycatch that come with the tons landed, summed over the bins of one region.

    The bins reduce to one coefficient, read as a scalar subquery: no join.
    """
    share = F.col("CATCH_SHARE") * F.col("DISCARD_RATIO") * F.col("MORTALITY")
    per_ton = bins.filter(F.col("REGION") == region).agg(F.sum(share)).scalar()
    return projected.withColumns({name: F.col(tons) * per_ton for name, tons in columns.items()})


def extra_bycatch(df: DataFrame, base: str, columns: Mapping[str, str]) -> DataFrame:
    return df.withColumns({name: F.col(tons) - F.col(base) for name, tons in columns.items()})
