"""Trips: species side by side, per-trip ratio limits and year-to-date projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions.respond import ratio_limit, respond_ratio, step_round
from harborline.functions.semantics import complete_cases, sum_known
from harborline.functions.units import net_weight

TRIP_KEYS = ("LANDING_YEAR", "LANDING_MONTH", "LANDING_DATE", "VESSEL_NUM")


def species_side_by_side(
    tickets: DataFrame,
    species: Mapping[str, str],
    keys: Sequence[str] = TRIP_KEYS,
    species_column: str = "PACFIN_SPECIES_COMMON_NAME",
    weight: str = "LANDED_WEIGHT_LBS",
) -> DataFrame:
    """Pounds of each species per trip, 0 where a trip has none of it.

    ``species`` maps output columns to species names. Conditional sums need one exchange
    where a pivot needs two, and they pre-aggregate on the map side. Rows with a missing
    key or weight and rows of other species do not count, not even towards the existence
    of a trip.
    """
    listed = tickets.filter(F.col(species_column).isin(*species.values()))
    complete = complete_cases(listed, [*keys, weight])
    return complete.groupBy(*keys).agg(
        *(
            sum_known(F.when(F.col(species_column) == name, F.col(weight))).alias(column)
            for column, name in species.items()
        )
    )


def roll_up(wide: DataFrame, species: Sequence[str], keys: Sequence[str] = TRIP_KEYS) -> DataFrame:
    """Trips from tickets that already have their species side by side."""
    return (
        complete_cases(wide, keys)
        .groupBy(*keys)
        .agg(*(F.sum(column).alias(column) for column in species))
    )


def in_months(first: int, last: int) -> Column:
    return F.col("LANDING_MONTH").between(first, last)


def net_pounds(
    trips: DataFrame, species: str, keys: Sequence[str], divisor: float = 1.0
) -> DataFrame:
    """Net pounds per month, year or both; the divisor is the number of years behind an
    average. Gross pounds are summed first: sums of whole pounds are exact in any order."""
    return trips.groupBy(*keys).agg(
        (net_weight(F.sum(species)) / divisor).alias(f"{species}_NET")
    )


def gross_pounds(trips: DataFrame, species: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Gross pounds of each species per month, year or both."""
    return trips.groupBy(*keys).agg(*(F.sum(name).alias(f"{name}_GROSS") for name in species))


def with_ratio_limits(
    trips: DataFrame, target: str, per: Mapping[str, float], constant: float = 30.0
) -> DataFrame:
    """Stepped pounds of the target species and the limits they allow, one per scenario."""
    stepped = trips.withColumn("STEPPED", step_round(target))
    return stepped.withColumns(
        {f"LIMIT_{name}": ratio_limit("STEPPED", p, constant) for name, p in per.items()}
    )


def respond_to_ratio_limits(
    trips: DataFrame, limited: str, scenarios: Sequence[str], base: str, threshold: float = 0.8
) -> DataFrame:
    return trips.withColumns(
        {
            name: respond_ratio(limited, "STEPPED", f"LIMIT_{base}", f"LIMIT_{name}", threshold)
            for name in scenarios
        }
    )


def ratio_projection(
    trips: DataFrame,
    limited: str,
    target: str,
    per: Mapping[str, float],
    base: str,
    reference_year: int,
    current_year: int,
    last_actual_month: int,
    threshold: float = 0.8,
) -> DataFrame:
    """Net pounds of the current year: actual landings so far plus the remaining months of
    the reference year under each limit.

    Reference and current year are picked apart inside one aggregation, so the trips are
    computed once.
    """
    both = (F.col(limited) > 0) & (F.col(target) > 0)
    rest = (
        (F.col("LANDING_YEAR") == reference_year)
        & (F.col("LANDING_MONTH") > last_actual_month)
        & both
    )
    so_far = (F.col("LANDING_YEAR") == current_year) & (
        F.col("LANDING_MONTH") <= last_actual_month
    )
    scenarios = list(per)
    responded = respond_to_ratio_limits(
        with_ratio_limits(trips.filter(rest | so_far), target, per),
        limited,
        scenarios,
        base,
        threshold,
    )
    sums = responded.agg(
        sum_known(F.when(so_far, F.col(limited))).alias("SO_FAR"),
        *(sum_known(F.when(rest, F.col(name))).alias(name) for name in scenarios),
    )
    return sums.select(
        F.lit(current_year).alias("LANDING_YEAR"),
        F.col("SO_FAR").alias("SO_FAR_LBS"),
        *(F.col(name).alias(f"{name}_REST_LBS") for name in scenarios),
        *(net_weight(F.col("SO_FAR") + F.col(name)).alias(f"{name}_NET_LBS") for name in scenarios),
    )
