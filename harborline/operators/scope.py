"""Row filters of the models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions.semantics import ColumnOrName, as_column, lookup
from harborline.operators.totals import MONTHS_PER_PERIOD


def rolling_year(
    prior_year: int,
    last_month: Mapping[str, int] | int,
    fleet: str = "TYPE",
    year: str = "LANDING_YEAR",
    month: str = "LANDING_MONTH",
) -> Column:
    """Twelve months across two years: the prior year after ``last_month`` and the
    following year up to it. The last month may differ by fleet.

    Where the last month differs by fleet, a bound on year and month alone goes with the
    condition, so that months no fleet wants are left out at the scan.
    """

    def within(after, upto) -> Column:
        prior = (F.col(year) == prior_year) & (F.col(month) > after)
        return prior | ((F.col(year) == prior_year + 1) & (F.col(month) <= upto))

    if not isinstance(last_month, Mapping):
        return within(last_month, last_month)
    last = lookup(last_month, fleet)
    return within(min(last_month.values()), max(last_month.values())) & within(last, last)


def last_months(last_period: Mapping[str, int], grains: Mapping[str, str]) -> dict[str, int]:
    return {name: p * MONTHS_PER_PERIOD[grains[name]] for name, p in last_period.items()}


def listed_or_small(
    species: ColumnOrName,
    pounds: ColumnOrName,
    listed: Sequence[str],
    small_species: str,
    below_pounds: float,
) -> Column:
    """Listed species in any amount, one more species only below a weight."""
    species = as_column(species)
    small = (species == small_species) & (as_column(pounds) < below_pounds)
    return species.isin(*listed) | small


def outside_areas_for(
    species: ColumnOrName, area: ColumnOrName, restricted: str, areas: Sequence[str]
) -> Column:
    """An area exclusion that binds one species only; the others pass."""
    species = as_column(species)
    return (species != restricted) | ((species == restricted) & ~as_column(area).isin(*areas))
