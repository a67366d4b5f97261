"""Grouped sums of landings."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions.semantics import (
    complete_cases,
    divide,
    exact_mean,
    exact_sum_known,
    is_floating,
    known,
    lookup,
    sum_known,
)
from harborline.functions.units import exact_sum_tons, pounds_to_tons
from harborline.operators.estimate import POUNDS, PartialMonth

MONTHS_PER_PERIOD = {"month": 1, "two_month": 2}
REVENUE = "EXVESSEL_REVENUE"


def summed(df: DataFrame, name: str) -> Callable[[Column], Column]:
    """The sum for a column's type: doubles exactly, whatever the order; decimals and whole numbers are exact anyway."""
    return exact_sum_known if is_floating(df, name) else sum_known


def vessel_totals(
    tickets: DataFrame,
    keys: Sequence[str],
    weight: str = POUNDS,
    revenue: str = REVENUE,
    partial: PartialMonth | None = None,
) -> DataFrame:
    """Pounds and revenue per key combination, pounds of a partial month completed.

    Groups with a missing key are left out before the shuffle rather than after it; a
    group with only missing pounds is kept with total 0.
    """
    pounds = known(tickets, weight)
    return (
        complete_cases(tickets, keys)
        .groupBy(*keys)
        .agg(
            summed(tickets, revenue)(known(tickets, revenue)).alias("exvessel"),
            (summed(tickets, weight)(pounds) if partial is None else partial.scale_sum(pounds)).alias("tlbs"),
        )
    )


def fleet_period(grains: Mapping[str, str], fleet: str = "TYPE") -> Column:
    """Period number at each fleet's own grain, so that one grouping serves all fleets."""
    months = {name: MONTHS_PER_PERIOD[grain] for name, grain in grains.items()}
    return F.ceil(F.col("LANDING_MONTH") / lookup(months, fleet)).cast("int")


def with_price(totals: DataFrame) -> DataFrame:
    """Revenue per pound; groups with neither are undefined and drop out, revenue without
    pounds stays as infinity."""
    priced = totals.withColumn("price", divide("exvessel", "tlbs"))
    return complete_cases(priced)


def mean_price(priced: DataFrame, keys: Sequence[str]) -> DataFrame:
    return priced.groupBy(*keys).agg(exact_mean("price").alias("PRICE"))


def project_tons(
    responded: DataFrame, keys: Sequence[str], columns: Mapping[str, str]
) -> DataFrame:
    """Metric tons per key combination; ``columns`` maps output names to pounds columns."""
    return responded.groupBy(*keys).agg(
        *(exact_sum_tons(pounds).alias(name) for name, pounds in columns.items())
    )


def landings_tons(
    tickets: DataFrame,
    keys: Sequence[str],
    weight: str = POUNDS,
    revenue: str = REVENUE,
    partial: PartialMonth | None = None,
) -> DataFrame:
    """Tons and revenue per key combination, both completed for a partial month."""

    def total(name: str) -> Column:
        value = known(tickets, name)
        return summed(tickets, name)(value) if partial is None else partial.scale_sum(value)

    return tickets.groupBy(*keys).agg(
        pounds_to_tons(total(weight)).alias("P_SQMT"), total(revenue).alias("P_EXVESSEL")
    )


def sum_complete_cases(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Rows with a missing key or value go before the sum, so groups without any known
    value do not appear."""
    return complete_cases(df, [*keys, value]).groupBy(*keys).agg(F.sum(value).alias(value))
