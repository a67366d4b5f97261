"""The trip-limit models: tickets in, projected landings out.

Every model takes a ticket frame and its parameters. Scope filters come first and act on
columns that exist in the source or derive from one of them, so that they reach the scan;
then one shuffle totals the landings per vessel and period, limits are attached by
broadcast, the response is a column expression, and a second, small shuffle sums the tons.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions import labels, respond
from harborline.functions.semantics import complete_cases
from harborline.functions.units import sum_tons
from harborline.operators import bycatch, estimate, groups, limits, scope, totals, trips
from harborline.operators.limits import LimitSchedule
from harborline.plans import parameters as P
from harborline.sources.schema import SECTOR_CODE, codes_are_normalised

SPECIES = "NOMINAL_TO_ACTUAL_PACFIN_SPECIES_NAME"
Rules = Mapping[str, Mapping[str, tuple[str, float]]]


def in_sectors(tickets: DataFrame, codes: Sequence[str] = labels.GROUNDFISH_CODES) -> Column:
    """Whether a ticket's sector is listed; on codes declared as normalised the test reaches the scan."""
    return labels.has_code(SECTOR_CODE, *codes, normalised=codes_are_normalised(tickets))


def in_fleets(tickets: DataFrame, fleets: Sequence[str]) -> Column:
    """Whether a ticket's sector is of a listed fleet."""
    return in_sectors(tickets, [c for name in fleets for c in labels.FLEET_CODES.get(name, ())])


def grains_of(schedules: Sequence[LimitSchedule]) -> dict[str, str]:
    return {s.label: s.grain for s in schedules}


def respond_to(
    landed: DataFrame, rules: Rules, label: str = "TYPE", pounds: str = "tlbs"
) -> DataFrame:
    """``<scenario>LBS`` for each scenario, from the limits beside the totals."""
    return landed.withColumns(
        {
            f"{name}LBS": respond.respond_by_label(
                label, by_label, pounds, "TL_SQ", f"TL_{name}"
            )
            for name, by_label in rules.items()
        }
    )


def lingcod_vessel_totals(
    tickets: DataFrame,
    schedules: Sequence[LimitSchedule] = P.LINGCOD_LIMITS,
    species: Sequence[str] = P.LINGCOD_SPECIES,
    group: str = "LINGCOD",
    prior_year: int = 2022,
    subarea: str | None = "N42",
    last_actual: Mapping[str, int] = P.LAST_ACTUAL,
    species_column: str = SPECIES,
) -> DataFrame:
    """Pounds per vessel and period of a rolling year: two-month periods for one fleet and
    months for the other, as their limits have it, in one aggregation."""
    scoped = tickets.filter(
        (F.col("MANAGEMENT_GROUP_CODE") == "GRND")
        & F.col(species_column).isin(*species)
        & F.col("LANDING_YEAR").isin(prior_year, prior_year + 1)
        & in_sectors(tickets)
    )
    grains = grains_of(schedules)
    labelled = (
        scoped.withColumns(
            {
                "TYPE": labels.fleet_or_default(),
                "SECTOR": labels.sector_by_state(),
                "AREA": labels.area_or_default(),
                "SUBAREA": labels.subarea(),
                "SPPGROUP": labels.species_group_or_blank(species_column, species, group),
            }
        )
        .withColumn("PERIOD", totals.fleet_period(grains))
        .filter(scope.rolling_year(prior_year, scope.last_months(last_actual, grains)))
    )
    if subarea is not None:
        labelled = labelled.filter(F.col("SUBAREA") == subarea)
    keys = ["VESSEL_NUM", "PERIOD", "SUBAREA", "TYPE", "SECTOR", "LANDING_YEAR", "SPPGROUP"]
    return totals.vessel_totals(labelled, keys)


def lingcod_model(
    tickets: DataFrame,
    schedules: Sequence[LimitSchedule] = P.LINGCOD_LIMITS,
    rules: Rules = P.LINGCOD_RULES,
    by: Sequence[str] = ("TYPE",),
    bins: Sequence[tuple] = P.DEPTH_BINS,
    region: str = "OR",
    in_season: bool = False,
    last_actual: Mapping[str, int] = P.LAST_ACTUAL,
    **scope_options,
) -> DataFrame:
    """Tons under the status quo and each alternative, and the bycatch that comes with
    them. In season, alternatives act only after the last period of actual landings and
    appear as ``INS_`` columns."""
    spark = tickets.sparkSession
    landed = lingcod_vessel_totals(tickets, schedules, last_actual=last_actual, **scope_options)
    responded = respond_to(
        limits.attach_limits(landed, limits.limits_side_by_side(spark, schedules)), rules
    )
    prefix = "P_" if in_season else ""
    tons = {f"{prefix}SQ_MT": "tlbs"} | {f"{prefix}{a}_MT": f"{a}LBS" for a in rules}
    impacts = {"SQ_YEYE_MT": f"{prefix}SQ_MT"}
    impacts |= {f"{a.replace('A', 'ALT')}_YEYE_MT": f"{prefix}{a}_MT" for a in rules}
    extra = {f"Extra_YEYE_{a.replace('A', 'ALT')}": f"{a.replace('A', 'ALT')}_YEYE_MT" for a in rules}
    if in_season:
        responded = responded.withColumns(
            {
                f"INS_{a}LBS": respond.in_season("tlbs", f"{a}LBS", "TYPE", "PERIOD", last_actual)
                for a in rules
            }
        )
        tons |= {f"INS_{a}_MT": f"INS_{a}LBS" for a in rules}
        for a in rules:
            alt = a.replace("A", "ALT")
            impacts[f"INS_{alt}_YEYE_MT"] = f"INS_{a}_MT"
            extra[f"Extra_INS_YEYE_{alt}"] = f"INS_{alt}_YEYE_MT"
    projected = totals.project_tons(responded, by, tons)
    with_bycatch = bycatch.bycatch_tons(
        projected, bycatch.bin_table(spark, bins), region, impacts
    )
    return bycatch.extra_bycatch(with_bycatch, "SQ_YEYE_MT", extra)


def strict_labels(tickets: DataFrame) -> DataFrame:
    return tickets.withColumns(
        {
            "PERIOD": labels.period(),
            "TYPE": labels.fleet(),
            "SECTOR": labels.sector(),
            "AREA": labels.area(),
        }
    )


def under_way(
    tickets: DataFrame, year: int, month: int | None, day_source: DataFrame | None
) -> estimate.PartialMonth | None:
    if month is None:
        return None
    return estimate.partial_month(tickets, year, month, day_source=day_source)


def pop_model(
    tickets: DataFrame,
    schedules: Sequence[LimitSchedule] = P.POP_LIMITS,
    rules: Rules = P.POP_RULES,
    species: Sequence[str] = P.POP_SPECIES,
    group: str = "POP",
    year: int = 2019,
    partial_month: int | None = 12,
    area: str = "N4010",
    species_column: str = SPECIES,
    day_source: DataFrame | None = None,
) -> DataFrame:
    """One area and year, the last month completed; a fleet without limits drops out."""
    current = tickets.filter(F.col("LANDING_YEAR") == year)
    partial = under_way(current, year, partial_month, day_source)
    # Landings of a fleet without limits find none below; they go here, before any sum.
    limited = in_fleets(tickets, [s.label for s in schedules])
    labelled = (
        strict_labels(current.filter(F.col(species_column).isin(*species) & limited))
        .withColumn("SPPGROUP", labels.species_group(species_column, species, group))
        .filter(F.col("AREA") == area)
    )
    keys = ["VESSEL_NUM", "PERIOD", "AREA", "TYPE", "LANDING_YEAR", "SPPGROUP"]
    landed = totals.vessel_totals(labelled, keys, partial=partial)
    limits.check_grain(schedules, {"LE": "two_month", "OA": "two_month"})
    wide = limits.limits_side_by_side(tickets.sparkSession, schedules)
    responded = respond_to(limits.attach_limits(landed, wide), rules)
    tons = {"P_SQMT": "tlbs"} | {f"P_{a}_MT": f"{a}LBS" for a in rules}
    return totals.project_tons(responded, ["LANDING_YEAR", "TYPE"], tons)


def yellowtail_model(
    tickets: DataFrame,
    schedules: Sequence[LimitSchedule] = P.YELLOWTAIL_LIMITS,
    rules: Rules = P.YELLOWTAIL_RULES,
    species: Sequence[str] = P.YELLOWTAIL_SPECIES,
    group: str = "YT",
    year: int = 2024,
    before_month: int = 6,
    area: str = "N4010",
    species_column: str = SPECIES,
) -> DataFrame:
    """The first months of a year in one area, by month and fleet."""
    labelled = (
        strict_labels(
            tickets.filter(
                (F.col("LANDING_YEAR") == year)
                & (F.col("LANDING_MONTH") < before_month)
                & F.col(species_column).isin(*species)
            )
        )
        .withColumn("SPPGROUP", labels.species_group(species_column, species, group))
        .filter(F.col("AREA") == area)
    )
    landed = totals.vessel_totals(
        labelled, ["VESSEL_NUM", "LANDING_MONTH", "AREA", "TYPE", "LANDING_YEAR", "SPPGROUP"]
    )
    limits.check_grain(schedules, {"LE": "month", "OA": "month"})
    wide = limits.limits_side_by_side(tickets.sparkSession, schedules)
    by_month = wide.withColumnRenamed("PERIOD", "LANDING_MONTH")
    responded = respond_to(
        limits.attach_limits(landed, by_month, ["LANDING_MONTH", "TYPE"]), rules
    )
    tons = {"P_SQMT": "tlbs"} | {f"P_{a}_MT": f"{a}LBS" for a in rules}
    return totals.project_tons(responded, ["LANDING_MONTH", "TYPE"], tons)


def shelf_model(
    tickets: DataFrame,
    schedules: Sequence[LimitSchedule] = P.SHELF_LIMITS,
    rules: Rules = P.SHELF_RULES,
    species: Sequence[str] = P.SHELF_SPECIES,
    years: tuple[int, int] = (2021, 2022),
    last_month: int | None = 10,
    area: str | None = "N4010",
    species_column: str = SPECIES,
) -> DataFrame:
    """Monthly limits of both fleets, each with its own threshold.

    With ``last_month`` the scope is the rolling year that ends with it in the second
    year; without, all months of the years. ``area=None`` takes all areas.
    """
    first, last = years
    scoped = tickets.filter(
        F.col("LANDING_YEAR").between(first, last)
        & (F.col("MANAGEMENT_GROUP_CODE") == "GRND")
        & F.col(species_column).isin(*species)
        & (F.col("PARTICIPATION_GROUP_CODE") == "C")
        & (F.col("COUNCIL_CODE") == "P")
        & in_sectors(tickets)
    )
    if last_month is not None:
        scoped = scoped.filter(scope.rolling_year(last - 1, last_month))
    labelled = scoped.withColumns(
        {
            "TYPE": labels.fleet_or_default(),
            "SECTOR": labels.sector_by_state(),
            "AREA": labels.area_or_default(),
            "SUBAREA": labels.subarea(),
        }
    )
    if area is not None:
        labelled = labelled.filter(F.col("AREA") == area)
    landed = totals.vessel_totals(
        labelled, ["VESSEL_NUM", "LANDING_MONTH", "AREA", "TYPE", "SECTOR", "LANDING_YEAR"]
    )
    limits.check_grain(schedules, {"LE": "month", "OA": "month"})
    wide = limits.limits_side_by_side(tickets.sparkSession, schedules)
    by_month = wide.withColumnRenamed("PERIOD", "LANDING_MONTH")
    responded = respond_to(
        limits.attach_limits(landed, by_month, ["LANDING_MONTH", "TYPE"]), rules
    )
    tons = {"SQ_MT": "tlbs"} | {f"{a}_MT": f"{a}LBS" for a in rules}
    return totals.project_tons(responded, ["TYPE"], tons)


def widow_shelf_totals(
    tickets: DataFrame,
    members: Mapping[str, Sequence[str]] = P.WIDOW_AND_SHELF_GROUPS,
    year: int = 2019,
    partial_month: int | None = 12,
    species_column: str = SPECIES,
    day_source: DataFrame | None = None,
) -> DataFrame:
    current = tickets.filter(F.col("LANDING_YEAR") == year)
    partial = under_way(current, year, partial_month, day_source)
    listed = current.filter(F.col(species_column).isin(*groups.listed_species(members)))
    membership = groups.membership_table(tickets.sparkSession, members, species_column)
    grouped = groups.into_groups(strict_labels(listed), membership, species_column)
    keys = ["VESSEL_NUM", "LANDING_MONTH", "AREA", "TYPE", "LANDING_YEAR", "SPPGROUP"]
    return totals.vessel_totals(grouped, keys, partial=partial)


def widow_shelf_model(
    tickets: DataFrame,
    schedules: Sequence[LimitSchedule] = P.WIDOW_SHELF_LIMITS,
    threshold: float = P.WIDOW_SHELF_THRESHOLD,
    **scope_options,
) -> DataFrame:
    """Overlapping groups, each with its own alternative; the combined group is held to
    its status quo limit. The partial month is scaled once."""
    landed = widow_shelf_totals(tickets, **scope_options)
    limits.check_grain(schedules, {"LE": "month", "OA": "month"})
    wide = limits.limits_side_by_side(tickets.sparkSession, schedules)
    by_month = wide.withColumnRenamed("PERIOD", "LANDING_MONTH")
    attached = limits.attach_limits(landed, by_month, ["LANDING_MONTH", "TYPE"])

    def raised(scenario: str) -> Column:
        return respond.respond_raise("tlbs", "TL_SQ", f"TL_{scenario}", threshold)

    responded = attached.withColumns(
        {
            "SQ_Widow": respond.for_group("SPPGROUP", "WIDOW", F.col("tlbs")),
            "SQ_Shelf": respond.for_group(
                "SPPGROUP", "WIDOW&SHELF", respond.cap_at("tlbs", "TL_SQ")
            ),
            "A1_WIDOWLBS": respond.for_group("SPPGROUP", "WIDOW", raised("A1_WIDOW")),
            "A1_SHELFLBS": respond.for_group("SPPGROUP", "SHELF", raised("A1_SHELF")),
        }
    )
    return totals.project_tons(
        responded,
        ["TYPE", "LANDING_YEAR", "AREA"],
        {
            "P_SQMT_Widow": "SQ_Widow",
            "P_SQMT_Shelf": "SQ_Shelf",
            "P_WIDOW_MT": "A1_WIDOWLBS",
            "P_SHELF_MT": "A1_SHELFLBS",
        },
    )


def nearshore_landings(
    tickets: DataFrame,
    year: int = 2019,
    partial_month: int | None = 12,
    species: Sequence[str] = P.NEARSHORE_SPECIES,
    small_species: str = P.SMALL_SPECIES,
    small_below: float = P.SMALL_SPECIES_BELOW,
    rules: Sequence[labels.GroupRule] = P.NEARSHORE_RULES,
    species_column: str = SPECIES,
    day_source: DataFrame | None = None,
) -> DataFrame:
    """Current-year landings of the nearshore sectors by area and species group, pounds
    and revenue of the last month completed. Rows with any missing value are left out."""
    current = tickets.filter(F.col("LANDING_YEAR") == year)
    complete = complete_cases(current.withColumn("SECTOR", labels.nearshore_only()))
    partial = under_way(complete, year, partial_month, day_source)
    pounds = totals.POUNDS if partial is None else partial.scale_row(totals.POUNDS)
    kept = complete.filter(
        scope.listed_or_small(species_column, pounds, species, small_species, small_below)
    )
    labelled = kept.withColumnRenamed(species_column, "SPECIES").withColumns(
        {
            "AREA": labels.area(),
            "SUBAREA": labels.subarea_by_port(),
            "SPPGROUP": labels.species_group_by_rules("SPECIES", "AGENCY_CODE", rules),
        }
    )
    keys = ["AGENCY_CODE", "AREA", "SUBAREA", "SPECIES", "SPPGROUP"]
    return totals.landings_tons(labelled, keys, partial=partial)


def zone_totals(
    tickets: DataFrame,
    species: Sequence[str] = P.THORNYHEAD_SPECIES,
    group: str = "SPTH",
    year: int | None = 2023,
    grains: Mapping[str, str] | None = None,
    monthly_totals: bool = False,
    species_column: str = SPECIES,
) -> DataFrame:
    """Landed pounds per vessel, period and subarea. ``grains`` gives the period of each
    fleet; the open access fleet is told apart by registration rather than vessel number.
    ``monthly_totals`` keeps the months of a two-month period apart.
    """
    grains = grains or {"LE": "two_month", "OA": "two_month"}
    scoped = tickets.filter(F.col(species_column).isin(*species))
    if year is not None:
        scoped = scoped.filter(F.col("LANDING_YEAR") == year)
    labelled = (
        strict_labels(scoped)
        .withColumns(
            {
                "SUBAREA": labels.subarea_by_stock(),
                "SPPGROUP": labels.species_group(species_column, species, group),
                "VESSEL": F.when(F.col("TYPE") == "LE", F.col("VESSEL_NUM")).when(
                    F.col("TYPE") == "OA", F.col("VESSEL_REGISTRATION_ID")
                ),
            }
        )
        .withColumn("PERIOD", totals.fleet_period(grains))
    )
    keys = ["VESSEL", "PERIOD", "SUBAREA", "AREA", "TYPE", "SECTOR", "LANDING_YEAR", "SPPGROUP"]
    if monthly_totals:
        keys.append("LANDING_MONTH")
    return totals.vessel_totals(labelled, keys, weight="LANDED_WEIGHT_LBS")


def monthly_le_totals(
    tickets: DataFrame,
    species: Sequence[str] = P.THORNYHEAD_SPECIES,
    group: str = "SPTH",
    species_column: str = SPECIES,
) -> DataFrame:
    """Limited entry totals by month with their two-month period, and the price paid."""
    labelled = (
        strict_labels(tickets.filter(F.col(species_column).isin(*species)))
        .filter(F.col("TYPE") == "LE")
        .withColumns(
            {
                "SUBAREA": labels.subarea_by_stock(),
                "SPPGROUP": labels.species_group(species_column, species, group),
            }
        )
    )
    keys = [
        "VESSEL_NUM",
        "LANDING_MONTH",
        "PERIOD",
        "SUBAREA",
        "AREA",
        "TYPE",
        "SECTOR",
        "LANDING_YEAR",
        "SPPGROUP",
    ]
    return totals.with_price(totals.vessel_totals(labelled, keys, weight="LANDED_WEIGHT_LBS"))


def zone_tests() -> dict[str, Column]:
    le, oa = F.col("TYPE") == "LE", F.col("TYPE") == "OA"
    north = F.col("AREA") == "N4010"
    middle = F.col("SUBAREA") == "3427-4010"
    return {
        "LEN": le & north,
        "LES": le & middle,
        "LESS": le & (F.col("SUBAREA") == "South of 3427"),
        "OAN": oa & north,
        "OAS": oa & middle,
        "OASS": oa & (F.col("SUBAREA") == "South of 3427"),
    }


def zone_responses(
    tickets: DataFrame,
    schedules: Sequence[LimitSchedule] = P.ZONE_LIMITS,
    rules: Rules = P.ZONE_RULES,
    monthly_totals: bool = False,
    **scope_options,
) -> DataFrame:
    """Landings of each vessel and period in the zones that have limits, with ``<scenario>LBS``
    for each scenario. A zone is one of ``zone_tests``; another name is an error.

    Totals have the grain of their limits. With ``monthly_totals`` they are monthly
    whatever the limits are: limited entry months meet the limit of their two-month
    period, and open access months meet the limit of the same number, so those without
    one drop out. A scenario without a limit in a zone is null there.
    """
    by_zone, tests = grains_of(schedules), zone_tests()
    if unknown := sorted(set(by_zone) - set(tests)):
        raise ValueError(f"no zones {unknown}; there are {sorted(tests)}")
    if monthly_totals:
        grains = {"LE": "two_month", "OA": "month"}
    else:
        # A fleet's landings are totalled once, so its zones share a grain.
        grains = {"LE": "two_month", "OA": "two_month"} | {z[:2]: g for z, g in by_zone.items()}
        limits.check_grain(schedules, {zone: grains[zone[:2]] for zone in by_zone})
    landed = zone_totals(tickets, grains=grains, monthly_totals=monthly_totals, **scope_options)
    zoned = groups.into_zones(landed, {zone: tests[zone] for zone in by_zone})
    wide = limits.limits_side_by_side(tickets.sparkSession, schedules, label="ZONE")
    return respond_to(limits.attach_limits(zoned, wide, ["PERIOD", "ZONE"]), rules, "ZONE")


def zones_model(
    tickets: DataFrame,
    schedules: Sequence[LimitSchedule] = P.ZONE_LIMITS,
    rules: Rules = P.ZONE_RULES,
    **options,
) -> DataFrame:
    """Tons of the fleets by latitude zone, limits raised or lowered; ``options`` are those of
    ``zone_responses``."""
    responded = zone_responses(tickets, schedules, rules, **options)
    return responded.groupBy("ZONE").agg(
        sum_tons("tlbs").alias("SQ_MT"),
        *(
            F.when(F.count(f"TL_{a}") > 0, sum_tons(f"{a}LBS")).alias(f"{a}_MT")
            for a in rules
        ),
    )


def closest_year_model(
    tickets: DataFrame,
    years: tuple[int, int, int],
    through_month: int = 8,
    species: Sequence[str] | None = None,
    species_column: str = SPECIES,
) -> DataFrame:
    """Whole-year estimate per area and species for the last of three years."""
    scoped = tickets.filter(F.col("LANDING_YEAR").isin(*years))
    if species is not None:
        scoped = scoped.filter(F.col(species_column).isin(*species))
    labelled = scoped.withColumns(
        {"AREA": labels.area_or_default(), "SPECIES": F.col(species_column)}
    )
    wide = estimate.years_side_by_side(labelled, years, through_month)
    return estimate.closest_year_estimate(wide).select("AREA", "SPECIES", "MT_z", "ESTIMATED_MT")


def in_trip_fishery(
    agency: str = "W", fisheries: Sequence[str] = P.TRIP_FISHERIES
) -> Column:
    return (
        (F.col("AGENCY_CODE") == agency)
        & F.col("GMT_SABLEFISH_CODE").isin(*fisheries)
        & (F.col("REMOVAL_TYPE_CODE") != P.EXCLUDED_REMOVAL)
    )


def incidental_trips(
    tickets: DataFrame,
    species: Mapping[str, str] = P.TRIP_SPECIES,
    species_column: str = "PACFIN_SPECIES_COMMON_NAME",
    season: tuple[int, int] = (4, 10),
    agency: str = "W",
    fisheries: Sequence[str] = P.TRIP_FISHERIES,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Trips of one fishery in season with the two species side by side. Every filter acts on
    the flat tickets, before any sum or shuffle."""
    limited = next(iter(species.values()))
    if years is not None:
        tickets = tickets.filter(F.col("LANDING_YEAR").isin(*years))
    kept = tickets.filter(
        in_trip_fishery(agency, fisheries)
        & trips.in_months(*season)
        & scope.outside_areas_for(
            species_column, "CATCH_AREA_CODE", limited, P.HALIBUT_EXCLUDED_AREAS
        )
    )
    return trips.species_side_by_side(kept, species, species_column=species_column)


def ratio_model(
    trip_frame: DataFrame,
    reference_year: int = 2019,
    current_year: int = 2020,
    last_actual_month: int = 8,
    per: Mapping[str, float] = P.RATIO_LIMITS,
    base: str = P.RATIO_BASE,
    species: Sequence[str] = tuple(P.TRIP_SPECIES),
) -> DataFrame:
    limited, target = species
    return trips.ratio_projection(
        trip_frame, limited, target, per, base, reference_year, current_year, last_actual_month
    )


def incidental_projection(
    tickets: DataFrame,
    species: Mapping[str, str] = P.TRIP_SPECIES,
    species_column: str = "PACFIN_SPECIES_COMMON_NAME",
    season: tuple[int, int] = (4, 10),
    agency: str = "W",
    fisheries: Sequence[str] = P.TRIP_FISHERIES,
    reference_year: int = 2019,
    current_year: int = 2020,
    **projection_options,
) -> DataFrame:
    """The trip model from flat tickets."""
    years = (reference_year, current_year)
    trip_frame = incidental_trips(
        tickets, species, species_column, season, agency, fisheries, years
    )
    return ratio_model(trip_frame, *years, species=tuple(species), **projection_options)


MODELS = {
    "lingcod": lingcod_model,
    "nearshore": nearshore_landings,
    "pop": pop_model,
    "zones": zones_model,
    "shelf": shelf_model,
    "widow_shelf": widow_shelf_model,
    "yellowtail": yellowtail_model,
    "closest_year": closest_year_model,
    "incidental": incidental_projection,
}
