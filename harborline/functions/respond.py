"""Behavioural rules: what would have been landed under another limit.

``landed`` are the pounds of one vessel and period, ``status_quo`` and ``alternative``
the limits, ``threshold`` the share of the status quo limit from which a vessel counts
as targeting.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions.semantics import ColumnOrName, as_column, if_known, lookup


def _ratio(landed: Column, limit: Column) -> Column:
    """Share of the limit landed: infinite for any landing under a limit of 0, unknown when
    nothing was landed under it."""
    under_none = F.when(landed != 0, landed * float("inf"))
    return F.when(limit == 0, under_none).otherwise(landed / limit)


def _respond(t: Column, sq: Column, alt: Column, threshold, above: Column) -> Column:
    ratio = _ratio(t, sq)
    return (
        F.when(t >= alt, above)
        .when(ratio >= threshold, alt)
        .when((ratio < threshold) & alt.isNotNull(), t)
    )


def respond_raise(
    landed: ColumnOrName, status_quo: ColumnOrName, alternative: ColumnOrName, threshold
) -> Column:
    """Targeting vessels move up to the alternative; pounds already above it stay."""
    t, sq, alt = as_column(landed), as_column(status_quo), as_column(alternative)
    return _respond(t, sq, alt, threshold, above=t)


def respond_cap(
    landed: ColumnOrName, status_quo: ColumnOrName, alternative: ColumnOrName, threshold
) -> Column:
    """Like the raise rule, but pounds above the alternative are cut down to it."""
    t, sq, alt = as_column(landed), as_column(status_quo), as_column(alternative)
    return _respond(t, sq, alt, threshold, above=alt)


def respond_by_label(
    label: ColumnOrName,
    rules: Mapping[str, tuple[str, float]],
    landed: ColumnOrName,
    status_quo: ColumnOrName,
    alternative: ColumnOrName,
) -> Column:
    """Each fleet or zone by its own rule, "raise" or "cap", and threshold; labels without
    a rule are null."""
    unknown = sorted({rule for rule, _ in rules.values()} - {"raise", "cap"})
    if unknown:
        raise ValueError(f"no response rule {unknown}")
    t, sq, alt = as_column(landed), as_column(status_quo), as_column(alternative)
    capped = [name for name, (rule, _) in rules.items() if rule == "cap"]
    thresholds = {name: float(threshold) for name, (_, threshold) in rules.items()}
    above = t
    if len(capped) == len(rules):
        above = alt
    elif capped:
        above = F.when(as_column(label).isin(*capped), alt).otherwise(t)
    if len(set(thresholds.values())) == 1:
        threshold = F.lit(next(iter(thresholds.values())))
    else:
        threshold = lookup(thresholds, label)
    has_rule = as_column(label).isin(*rules)
    return F.when(has_rule, _respond(t, sq, alt, threshold, above))


def cap_at(landed: ColumnOrName, limit: ColumnOrName) -> Column:
    t, cap = as_column(landed), as_column(limit)
    return if_known(t >= cap, cap, t, [t, cap])


def for_group(group: ColumnOrName, wanted: str, response: Column) -> Column:
    """The response for rows of one species group, 0 for the others."""
    return if_known(as_column(group) == wanted, response, F.lit(0.0), [group])


def in_season(
    landed: ColumnOrName,
    responded: ColumnOrName,
    fleet: ColumnOrName,
    period: ColumnOrName,
    last_actual: Mapping[str, int],
) -> Column:
    """Responded pounds only after each fleet's last period of actual landings."""
    projected = as_column(period) > lookup(last_actual, fleet)
    return F.when(projected, as_column(responded)).when(~projected, as_column(landed))


def step_round(pounds: ColumnOrName, step: int = 1000, up_from: int = 900) -> Column:
    """Round to whole steps, upwards only from ``up_from`` on; below the first step keep
    the pounds themselves."""
    pounds = as_column(pounds)
    stepped = F.floor((pounds + (step - up_from)) / step) * step
    return F.when(stepped == 0, pounds).otherwise(stepped.cast("double"))


def ratio_limit(stepped: ColumnOrName, per: float, constant: float = 30.0) -> Column:
    """Pounds of one species allowed on a trip, as a share of the other species' pounds."""
    return as_column(stepped) / per + constant


def respond_ratio(
    landed: ColumnOrName,
    stepped: ColumnOrName,
    status_quo_limit: ColumnOrName,
    limit: ColumnOrName,
    threshold: float = 0.8,
    exempt_below: float = 1000,
) -> Column:
    """Trips of targeting vessels land exactly the limit; small trips are left alone."""
    landed, stepped = as_column(landed), as_column(stepped)
    ratio = _ratio(landed, as_column(status_quo_limit))
    return (
        F.when(stepped < exempt_below, landed)
        .when(ratio >= threshold, as_column(limit))
        .when((ratio < threshold) & stepped.isNotNull(), landed)
    )
