"""Species groups that overlap: one landing can count in several."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.operators.tables import parameter_table


def membership_table(
    spark: SparkSession,
    groups: Mapping[str, Sequence[str]],
    species_column: str,
    group_column: str = "SPPGROUP",
) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField(species_column, T.StringType(), False),
            T.StructField(group_column, T.StringType(), False),
        ]
    )
    rows = [(s, group) for group, members in groups.items() for s in dict.fromkeys(members)]
    return parameter_table(spark, schema, rows)


def into_groups(tickets: DataFrame, membership: DataFrame, species_column: str) -> DataFrame:
    """One row per ticket line and group it belongs to; lines in no group drop out.

    One scan and one aggregation then serve all groups. A join does not filter the scan;
    put ``listed_species`` in a filter on the tickets first.
    """
    return tickets.join(membership, species_column, "inner")


def listed_species(groups: Mapping[str, Sequence[str]]) -> list[str]:
    return list(dict.fromkeys(s for members in groups.values() for s in members))


def into_zones(totals: DataFrame, zones: Mapping[str, Column], column: str = "ZONE") -> DataFrame:
    """One row per zone a total belongs to; zones may overlap, totals in none drop out."""
    tests = [F.when(test, F.lit(name)) for name, test in zones.items()]
    return totals.withColumn(column, F.explode(F.array_compact(F.array(*tests))))
