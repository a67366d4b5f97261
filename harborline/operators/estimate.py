"""Completion of a year that is still under way."""

from __future__ import annotations

import calendar
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions.semantics import (
    complete_cases,
    divide,
    exact_sum,
    exact_sum_known,
    if_known,
    nan_to_null,
    sum_known,
)
from harborline.functions.units import pounds_to_tons, sum_tons

POUNDS = "ROUND_WEIGHT_LBS"


@dataclass(frozen=True)
class PartialMonth:
    """A month still under way: its rows, its length and the last day landed in it."""

    in_month: Column
    days: int
    last_day: Column

    def scale(self, value: Column) -> Column:
        return value * self.days / self.last_day

    def scale_row(self, name: str) -> Column:
        """The value of one row, brought to the whole month where it is of that month."""
        value = F.col(name)
        dated = ["LANDING_YEAR", "LANDING_MONTH"]
        return if_known(self.in_month, self.scale(value.cast("double")), value, dated)

    def scale_sum(self, value: Column) -> Column:
        """Sum of values with those of the month scaled. Each part is summed exactly before it is
        scaled, so that neither the order nor the partitioning of the rows shows in the result."""
        partial = exact_sum(F.when(self.in_month, value))
        others = exact_sum_known(F.when(~self.in_month, value))
        return others + F.coalesce(self.scale(partial), F.lit(0.0))


def partial_month(
    tickets: DataFrame,
    year: int,
    month: int,
    days: int | None = None,
    day_source: DataFrame | None = None,
) -> PartialMonth:
    """The last day is a scalar subquery: one aggregated row, no join. ``day_source`` may
    be any frame with the same ticket dates; a narrow one spares the subquery the joins or
    columns that ``tickets`` carries."""
    in_month = (F.col("LANDING_YEAR") == year) & (F.col("LANDING_MONTH") == month)
    dated = tickets if day_source is None else day_source
    last_day = dated.filter(in_month).agg(F.max(F.col("LANDING_DAY").cast("int"))).scalar()
    return PartialMonth(in_month, days or calendar.monthrange(year, month)[1], last_day)


def complete_partial_month(
    tickets: DataFrame, partial: PartialMonth, columns: Sequence[str] = (POUNDS,)
) -> DataFrame:
    """Scale the rows of the last month by its length over the last day landed in it."""
    return tickets.withColumns({c: partial.scale_row(c) for c in columns})


def part_year_ratio(
    tickets: DataFrame,
    through_month: int,
    keys: Sequence[str] = ("LANDING_YEAR", "AREA", "SPECIES"),
    pounds: str = POUNDS,
) -> DataFrame:
    """Tons landed through a month beside those of the whole year, and their ratio.

    Both sums come from one pass. The part-year sum is 0 where nothing was landed by
    then, the ratio NaN where the whole year is 0 as well.
    """
    so_far = F.col("LANDING_MONTH") <= through_month
    sums = (
        complete_cases(tickets, [*keys, pounds])
        .groupBy(*keys)
        .agg(
            sum_tons(F.when(so_far, F.col(pounds))).alias("THRU_MT"),
            sum_tons(pounds).alias("MT"),
        )
    )
    return sums.withColumn("RATIO", divide("THRU_MT", "MT"))


def years_side_by_side(
    tickets: DataFrame,
    years: Sequence[int],
    through_month: int,
    keys: Sequence[str] = ("AREA", "SPECIES"),
    pounds: str = POUNDS,
    complete: bool = True,
) -> DataFrame:
    """Part-year and whole-year landings of three years on one row per key, in pounds
    (``THRU_LBS_x``, ``LBS_x``) and in tons (``THRU_x``, ``MT_x``), with their ratio.

    The last year drives: keys without landings then are absent. The first year counts
    only where the second has landings too, as in two right joins one after the other,
    here from one pass. ``complete=False`` keeps rows with a missing key, which match
    each other, and counts missing pounds as 0.
    """
    first, second, last = years
    scoped = tickets.filter(F.col("LANDING_YEAR").isin(*years))
    scoped = complete_cases(scoped, [*keys, pounds]) if complete else scoped
    parts = {"x": first, "y": second, "z": last}
    aggregates = []
    for name, year in parts.items():
        in_year = F.col("LANDING_YEAR") == year
        so_far = in_year & (F.col("LANDING_MONTH") <= through_month)
        aggregates += [
            sum_known(F.when(so_far, F.col(pounds))).cast("double").alias(f"THRU_LBS_{name}"),
            sum_known(F.when(in_year, F.col(pounds))).cast("double").alias(f"LBS_{name}"),
            F.bool_or(in_year).alias(f"HAS_{name}"),
        ]
    sums = scoped.groupBy(*keys).agg(*aggregates).filter("HAS_z")
    wide = {}
    for name in ("x", "y"):
        for part in ("THRU_LBS", "LBS"):
            wide[f"{part}_{name}"] = F.when(F.col("HAS_y"), F.col(f"{part}_{name}")).otherwise(0.0)
        ratio = nan_to_null(divide(f"THRU_LBS_{name}", f"LBS_{name}"))
        wide[f"RATIO_{name}"] = F.coalesce(F.when(F.col("HAS_y"), ratio), F.lit(0.0))
    tons = {}
    for name in parts:
        tons[f"THRU_{name}"] = pounds_to_tons(f"THRU_LBS_{name}")
        tons[f"MT_{name}"] = pounds_to_tons(f"LBS_{name}")
    return sums.withColumns(wide).withColumns(tons).drop(*(f"HAS_{name}" for name in parts))


def closest_year_estimate(wide: DataFrame) -> DataFrame:
    """Whole-year estimate from whichever earlier year was nearer so far; a tie takes the
    second. Never below the landings already made; unknown when nothing can be said.

    Gaps are compared in pounds, whose sums are exact where the pounds are whole, and
    the estimate turns into tons last.
    """
    gap_x = F.abs(F.col("THRU_LBS_z") - F.col("THRU_LBS_x"))
    gap_y = F.abs(F.col("THRU_LBS_z") - F.col("THRU_LBS_y"))
    ratio = F.when(gap_y > gap_x, F.col("RATIO_x")).otherwise(F.col("RATIO_y"))
    estimate = nan_to_null(divide("THRU_LBS_z", "RATIO"))
    landed, whole = F.col("LBS_z"), F.col("ESTIMATED_LBS")
    floored = if_known(landed > whole, landed, whole, ["LBS_z", "ESTIMATED_LBS"])
    return (
        wide.withColumn("RATIO", ratio)
        .withColumn("ESTIMATED_LBS", estimate)
        .withColumn("ESTIMATED_MT", pounds_to_tons(floored))
    )
