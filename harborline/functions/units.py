"""Unit conversions."""

from __future__ import annotations

from pyspark.sql import Column

from harborline.functions.semantics import ColumnOrName, as_column, exact_sum_known, sum_known

# Fixed values.
POUNDS_PER_METRIC_TON = 2204.6
NET_WEIGHT_SHARE = 0.88


def pounds_to_tons(pounds: ColumnOrName) -> Column:
    return as_column(pounds) / POUNDS_PER_METRIC_TON


def sum_tons(pounds: ColumnOrName) -> Column:
    """Pounds are summed before the division: sums of whole pounds are exact in any
    order, so the result does not depend on how the rows are partitioned."""
    return pounds_to_tons(sum_known(pounds))


def exact_sum_tons(pounds: ColumnOrName) -> Column:
    """Tons of pounds that need not be whole: completed months, limits, responses."""
    return pounds_to_tons(exact_sum_known(pounds))


def net_weight(gross: ColumnOrName, share: float = NET_WEIGHT_SHARE) -> Column:
    return as_column(gross) * share
