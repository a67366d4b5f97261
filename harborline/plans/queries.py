"""Registered queries: every operator and model over the sample tables.

Each callable takes a session and a table directory. Doubles are rounded so that results
compare across engines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.functions import labels, respond
from harborline.functions.labels import GroupRule
from harborline.functions.semantics import complete_cases, exact_sum_known, fill_missing, sum_known
from harborline.functions.units import sum_tons
from harborline.operators import bycatch, estimate, groups, joins, limits, scope, totals, trips
from harborline.operators.limits import LimitSchedule
from harborline.plans import models
from harborline.plans import parameters as P
from harborline.operators.order import row_numbered
from harborline.operators.tables import Subset, append_subsets
from harborline.session import new_folder
from harborline.sources.results import as_text, read_result, write_result
from harborline.sources.sample_tables import (
    FROM_LINES,
    FROM_PART,
    FROM_SUPPLIER,
    sample_tickets,
    sample_trip_headers,
    sample_trip_lines,
    table,
)
from harborline.sources.stored import buckets_for, store_by_ticket, stored
from harborline.sources.tickets import QUOTE, conform_text, parse_lines

NOMINAL = "NOMINAL_TO_ACTUAL_PACFIN_SPECIES_NAME"
COMMON = "PACFIN_SPECIES_COMMON_NAME"
LBS, LANDED, REVENUE = "ROUND_WEIGHT_LBS", "LANDED_WEIGHT_LBS", "EXVESSEL_REVENUE"

# The sample tables end in November 2001, which serves as the month under way.
YEAR, MONTH = 2001, 11
PRIOR = YEAR - 1

# Sample species in the roles of the fixed lists.
ONE_SPECIES = ("ECONOMY",)
WIDOW_GROUPS = {
    "WIDOW&SHELF": ("LARGE", "SMALL", "MEDIUM"),
    "SHELF": ("SMALL", "MEDIUM"),
    "WIDOW": ("LARGE",),
}
SHELF_NAMES = (
    "blue anvil", "blue bolt", "blue gear", "blue gizmo", "blue plate", "blue ring", "blue rod",
    "blue widget", "cold anvil", "cold bolt", "cold gear", "cold gizmo", "cold plate",
    "cold ring", "cold rod", "cold widget", "hot anvil", "hot bolt", "hot gear", "hot gizmo",
    "hot plate", "hot ring", "hot rod", "hot widget", "large anvil", "large bolt", "large gear",
    "large gizmo",
)
NEARSHORE_NAMES = (
    "red anvil", "red bolt", "red gear", "red gizmo", "red plate", "red ring", "red rod",
    "red widget", "old anvil", "old bolt", "old gear", "old gizmo", "old plate", "old ring",
    "old rod", "old widget",
)
SMALL_NAME, SMALL_BELOW = "new ring", 1500
NEARSHORE_SAMPLE_RULES = (
    GroupRule("NEARSHORE", ("red anvil", "red bolt", "red gear", "red gizmo", "old anvil")),
    GroupRule("RED BOLT AND GEAR", ("red bolt", "red gear", "red plate"), "O"),
    GroupRule("OLD BOLT AND GEAR", ("old bolt", "old gear"), "O"),
    GroupRule("OLD ANVIL W", ("old anvil",), "W"),
)
TRIP_SPECIES = {"PACIFIC_HALIBUT": "PROMO", "SABLEFISH": "STANDARD"}

_CODE = FROM_LINES["DAHL_GROUNDFISH_CODE"]


def _gap(test: str, columns: Mapping[str, str], *names: str) -> dict[str, str]:
    return {name: f"if({test}, null, {columns[name]})" for name in names}


# Missing values and odd codes by fixed rules: the sample tables have none of their own.
GAPS = {
    "DAHL_GROUNDFISH_CODE": f"""case l_linenumber when 1 then null
        when 2 then ltrim('0', {_CODE}) when 3 then concat(' ', {_CODE}, ' ')
        when 4 then '04' else {_CODE} end""",
    "AGENCY_CODE": f"""case when s_suppkey % 13 = 5 then null when s_suppkey % 13 = 6 then 'X'
        else {FROM_SUPPLIER["AGENCY_CODE"]} end""",
    **_gap("s_suppkey % 7 = 0", FROM_SUPPLIER, "PACFIN_CATCH_AREA_CODE"),
    **_gap("s_suppkey % 4 = 0", FROM_SUPPLIER, "ACL_CODE"),
    **_gap("s_suppkey % 11 = 0", FROM_SUPPLIER, "REGION_NAME"),
    **_gap("s_suppkey % 3 = 0", FROM_SUPPLIER, "SUBREGION_NAME"),
    **_gap("p_partkey % 9 = 0", FROM_PART, NOMINAL, COMMON),
    **_gap("l_suppkey % 10 = 2", FROM_LINES, "VESSEL_NUM"),
    **_gap("l_suppkey % 10 in (0, 1)", FROM_LINES, LBS, LANDED),
    **_gap("l_suppkey % 10 = 0", FROM_LINES, REVENUE),
}


def tickets_with_gaps(
    spark: SparkSession, sf_dir: str, columns: Sequence[str], years=None, codes=None
) -> DataFrame:
    return sample_tickets(spark, sf_dir, columns, years, overrides=GAPS, codes=codes)


def portable(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text."""
    types = {T.DecimalType: "double", T.DateType: "string"}
    return df.withColumns(
        {
            f.name: F.col(f.name).cast(types[type(f.dataType)])
            for f in df.schema.fields
            if type(f.dataType) in types
        }
    )


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    df = portable(df)
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({name: F.round(name, digits) for name in doubles})


def flag_infinite(df: DataFrame, name: str) -> DataFrame:
    """Infinity as null with a flag beside it: not every client can carry the value."""
    infinite = F.col(name) == float("inf")
    return df.withColumns(
        {
            f"{name}_INFINITE": F.coalesce(infinite, F.lit(False)).cast("int"),
            name: F.when(~infinite, F.col(name)),
        }
    )


def counted(df: DataFrame, *keys: str) -> DataFrame:
    return rounded(df.groupBy(*keys).agg(F.count("*").alias("N"), sum_known(LBS).alias("LBS")))


# --- sources -----------------------------------------------------------------------------


def q_tickets_scan(spark, sf_dir):
    return portable(sample_tickets(spark, sf_dir))


# Headers as exports spell them.
RAW_HEADERS = {
    "LANDING_YEAR": "PACFIN_YEAR",
    "LANDING_MONTH": "landing month",
    "NOMINAL_TO_ACTUAL_PACFIN_SPECIES_NAME": "SPECIES",
    "ROUND_WEIGHT_LBS": "ROUND_WEIGHT_LBS (SUM)",
    "LANDED_WEIGHT_LBS": " Landed.Weight.Lbs(SUM)",
}
# Fields as exports spell them: missing, blank, short and padded ones by line number.
RAW_FIELDS = {
    "DAHL_GROUNDFISH_CODE": """case l_linenumber when 1 then ltrim('0', DAHL_GROUNDFISH_CODE)
        when 2 then concat(' ', DAHL_GROUNDFISH_CODE, ' ') when 3 then 'NA'
        else DAHL_GROUNDFISH_CODE end""",
    "LANDING_DAY": "if(l_linenumber = 4, 'NA', concat(LANDING_DAY, ' '))",
    "ROUND_WEIGHT_LBS": "if(l_linenumber = 5, ' ', cast(ROUND_WEIGHT_LBS as string))",
    "AGENCY_CODE": "case l_linenumber when 6 then 'NA' when 7 then '' else AGENCY_CODE end",
    "LANDING_DATE": "if(l_linenumber = 7, 'NA', cast(LANDING_DATE as string))",
}


def _raw_tickets(spark, sf_dir, fields: Mapping[str, str] = RAW_FIELDS) -> DataFrame:
    """The lines as text under raw headers, with the line number beside them."""
    tickets = sample_tickets(spark, sf_dir, extra_lines=["l_linenumber"])
    names = [c for c in tickets.columns if c != "l_linenumber"]
    return tickets.select(
        "l_linenumber",
        *(
            F.expr(fields.get(c, f"cast({c} as string)")).alias(RAW_HEADERS.get(c, c))
            for c in names
        ),
    )


def q_tickets_conform(spark, sf_dir):
    """The lines as text under raw headers, through the cleaning that the CSV reader does."""
    return portable(conform_text(_raw_tickets(spark, sf_dir).drop("l_linenumber")))


# Fields with separators and quotes in them.
QUOTED_FIELDS = RAW_FIELDS | {
    "PACFIN_SPECIES_COMMON_NAME": """case l_linenumber when 1 then concat(PACFIN_SPECIES_COMMON_NAME, ', "fresh"')
        when 2 then concat('"', PACFIN_SPECIES_COMMON_NAME, '" \\\\, frozen') when 3 then '' else PACFIN_SPECIES_COMMON_NAME end""",
}


def _csv_lines(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """The lines as CSV records, and their header."""
    raw = _raw_tickets(spark, sf_dir, QUOTED_FIELDS)
    header = [c for c in raw.columns if c != "l_linenumber"]
    record = F.to_csv(F.struct(*(F.col(f"`{c}`") for c in header)), {"escape": QUOTE})
    return raw.select("l_linenumber", record.alias("value")), header


def q_tickets_csv(spark, sf_dir):
    """The lines as CSV records, through the reader's parse and cleaning; a record that does not fit would stop it."""
    lines, header = _csv_lines(spark, sf_dir)
    return portable(conform_text(parse_lines(lines, header)))


def q_csv_malformed(spark, sf_dir):
    """Records by year, among them some with a field too many and some with one too few, which have none."""
    lines, header = _csv_lines(spark, sf_dir)
    value = F.when(F.col("l_linenumber") == 6, F.concat("value", F.lit(',"one, more"')))
    value = value.when(F.col("l_linenumber") == 7, F.regexp_replace("value", ",[^,]*$", "")).otherwise(F.col("value"))
    parsed = parse_lines(lines.select(value.alias("value")), header, malformed="RECORD")
    flagged = parsed.withColumn("MALFORMED", F.col("RECORD").isNotNull().cast("int").cast("string")).drop("RECORD")
    names = {RAW_HEADERS["LANDING_YEAR"]: "LANDING_YEAR", RAW_HEADERS[LBS]: LBS}
    kept = flagged.select("MALFORMED", *(F.col(f"`{raw}`").alias(name) for raw, name in names.items()))
    clean = conform_text(kept).withColumn("MALFORMED", F.col("MALFORMED").cast("int"))
    return counted(clean, "MALFORMED", "LANDING_YEAR")


def _vessel_periods(spark, sf_dir, species=ONE_SPECIES):
    """Two-month pounds of one species per vessel and fleet."""
    tickets = sample_tickets(
        spark, sf_dir,
        ["LANDING_YEAR", "LANDING_MONTH", "VESSEL_NUM", "DAHL_GROUNDFISH_CODE", NOMINAL, LBS, REVENUE],
    )
    labelled = tickets.filter(F.col(NOMINAL).isin(*species)).withColumns(
        {"PERIOD": labels.period(), "TYPE": labels.fleet()}
    )
    return totals.vessel_totals(labelled, ["VESSEL_NUM", "LANDING_YEAR", "PERIOD", "TYPE"])


SAMPLE_LIMITS = (
    LimitSchedule("LE", "two_month", {"SQ": 7000, "A1": 9000, "A2": 5000}),
    LimitSchedule("OA", "two_month", {"SQ": 3500, "A1": 4500, "A2": 2500}),
)


def q_limit_table(spark, sf_dir):
    """Vessels and periods at or above each limit of the long table."""
    long = limits.limit_table(spark, P.LINGCOD_LIMITS[:1] + SAMPLE_LIMITS[1:])
    joined = limits.attach_limits(_vessel_periods(spark, sf_dir), long)
    return rounded(
        joined.groupBy("TYPE", "PERIOD", "SCENARIO", "LIMIT_LBS").agg(
            F.count("*").alias("N"),
            F.count_if(F.col("tlbs") >= F.col("LIMIT_LBS")).alias("N_AT_LIMIT"),
        )
    )


def q_widen_limits(spark, sf_dir):
    """The long limit table brought to one row for each period, joined with landings."""
    long = limits.limit_table(spark, SAMPLE_LIMITS)
    wide = limits.widen_limits(long, ["SQ", "A1", "A2"])
    joined = limits.attach_limits(_vessel_periods(spark, sf_dir), wide)
    return rounded(
        joined.groupBy("TYPE", "PERIOD", "TL_SQ", "TL_A1", "TL_A2").agg(
            F.count("*").alias("N"), sum_known("tlbs").alias("LBS")
        )
    )


# --- labels ------------------------------------------------------------------------------


def q_period(spark, sf_dir):
    tickets = sample_tickets(spark, sf_dir, ["LANDING_MONTH", LBS])
    return counted(tickets.withColumn("PERIOD", labels.period()), "LANDING_MONTH", "PERIOD")


def _label_query(columns: Sequence[str], name: str, label: Callable[[], Column]):
    def query(spark, sf_dir):
        tickets = tickets_with_gaps(spark, sf_dir, [*columns, LBS])
        return counted(tickets.withColumn(name, label()), *columns, name)

    return query


CODE, AGENCY, CATCH_AREA = "DAHL_GROUNDFISH_CODE", "AGENCY_CODE", "PACFIN_CATCH_AREA_CODE"
q_label_fleet = _label_query([CODE], "TYPE", labels.fleet)
q_label_fleet_default = _label_query([CODE], "TYPE", labels.fleet_or_default)
q_label_sector = _label_query([CODE], "SECTOR", labels.sector)
q_label_sector3 = _label_query([CODE, AGENCY], "SECTOR", labels.sector_by_state)
q_label_area = _label_query([AGENCY, CATCH_AREA], "AREA", labels.area)
q_label_area_default = _label_query([AGENCY, CATCH_AREA], "AREA", labels.area_or_default)
q_label_subarea = _label_query([AGENCY, CATCH_AREA], "SUBAREA", labels.subarea)
q_label_subarea_stock = _label_query(
    [AGENCY, CATCH_AREA, "ACL_CODE"], "SUBAREA", labels.subarea_by_stock
)
q_label_subarea_port = _label_query(
    ["REGION_NAME", "SUBREGION_NAME"], "SUBAREA", labels.subarea_by_port
)
q_species_precedence = _label_query(
    [COMMON, AGENCY],
    "SPPGROUP",
    lambda: labels.species_group_by_rules(COMMON, AGENCY, NEARSHORE_SAMPLE_RULES),
)


def q_species_group(spark, sf_dir):
    tickets = tickets_with_gaps(spark, sf_dir, [NOMINAL, LBS]).withColumns(
        {
            "SPPGROUP": labels.species_group(NOMINAL, ONE_SPECIES, "ECON"),
            "SPPGROUP_OR_BLANK": labels.species_group_or_blank(NOMINAL, ONE_SPECIES, "ECON"),
        }
    )
    return counted(tickets, NOMINAL, "SPPGROUP", "SPPGROUP_OR_BLANK")


def q_species_overlap(spark, sf_dir):
    tickets = sample_tickets(spark, sf_dir, ["LANDING_YEAR", NOMINAL, LBS])
    listed = tickets.filter(F.col(NOMINAL).isin(*groups.listed_species(WIDOW_GROUPS)))
    membership = groups.membership_table(spark, WIDOW_GROUPS, NOMINAL)
    return counted(groups.into_groups(listed, membership, NOMINAL), "LANDING_YEAR", "SPPGROUP")


# --- filters -----------------------------------------------------------------------------


def q_filter_in(spark, sf_dir):
    columns = [COMMON, CODE, "MANAGEMENT_GROUP_CODE", LBS]
    tickets = tickets_with_gaps(spark, sf_dir, columns, codes=labels.GROUNDFISH_CODES)
    kept = tickets.filter(
        (F.col("MANAGEMENT_GROUP_CODE") == "GRND")
        & F.col(COMMON).isin(*SHELF_NAMES)
        & models.in_sectors(tickets)
    )
    return counted(kept, COMMON)


def q_filter_between(spark, sf_dir):
    tickets = sample_tickets(spark, sf_dir, ["LANDING_YEAR", "LANDING_MONTH", LBS])
    kept = tickets.filter(F.col("LANDING_YEAR").between(1997, 1999))
    return counted(kept, "LANDING_YEAR", "LANDING_MONTH")


def q_filter_not(spark, sf_dir):
    headers = sample_trip_headers(spark, sf_dir).withColumn(
        "REMOVAL_TYPE_CODE", F.nullif("REMOVAL_TYPE_CODE", F.lit("O"))
    )
    kept = headers.filter(F.col("REMOVAL_TYPE_CODE") != P.EXCLUDED_REMOVAL)
    return kept.groupBy("LANDING_YEAR", "REMOVAL_TYPE_CODE").agg(F.count("*").alias("N"))


def q_rolling_year(spark, sf_dir):
    tickets = sample_tickets(
        spark, sf_dir, ["LANDING_YEAR", "LANDING_MONTH", CODE, LBS], (PRIOR, YEAR)
    )
    labelled = tickets.withColumn("TYPE", labels.fleet()).withColumn(
        "PERIOD", totals.fleet_period({"LE": "two_month", "OA": "month"})
    )
    last_months = scope.last_months(P.LAST_ACTUAL, {"LE": "two_month", "OA": "month"})
    kept = labelled.filter(scope.rolling_year(PRIOR, last_months))
    return counted(kept, "LANDING_YEAR", "TYPE", "PERIOD")


def q_complete_cases(spark, sf_dir):
    tickets = tickets_with_gaps(
        spark, sf_dir, ["LANDING_YEAR", "VESSEL_NUM", AGENCY, CATCH_AREA, CODE, LBS, REVENUE]
    )
    return counted(complete_cases(tickets), AGENCY, CATCH_AREA)


def q_filter_cond(spark, sf_dir):
    tickets = tickets_with_gaps(spark, sf_dir, [COMMON, LBS])
    kept = tickets.filter(
        scope.listed_or_small(COMMON, LBS, NEARSHORE_NAMES, SMALL_NAME, SMALL_BELOW)
    )
    return counted(kept, COMMON)


def q_filter_species_area(spark, sf_dir):
    tickets = tickets_with_gaps(spark, sf_dir, [NOMINAL, "CATCH_AREA_CODE", LBS])
    kept = tickets.filter(
        scope.outside_areas_for(NOMINAL, "CATCH_AREA_CODE", "PROMO", P.HALIBUT_EXCLUDED_AREAS)
    )
    return counted(kept, NOMINAL, "CATCH_AREA_CODE")


# --- joins -------------------------------------------------------------------------------


def q_limit_full_join(spark, sf_dir):
    """Landings by period beside two limit tables that each lack some periods."""
    schedules = [
        LimitSchedule("LE", "month", {"SQ": {1: 100.0, 2: 200.0, 3: 300.0}}),
        LimitSchedule("LE", "month", {"A1": {3: 330.0, 8: 880.0}}),
    ]
    tables = [limits.limits_side_by_side(spark, [s]).drop("TYPE") for s in schedules]
    tickets = sample_tickets(spark, sf_dir, ["LANDING_MONTH", LBS])
    landed = tickets.groupBy(labels.period().alias("PERIOD")).agg(sum_known(LBS).alias("LBS"))
    return rounded(limits.full_outer_chain([landed, *tables], ["PERIOD"]))


def q_limit_inner_join(spark, sf_dir):
    """Only one fleet has limits, and only in the first five periods."""
    schedule = LimitSchedule(
        "LE", "two_month", {"SQ": {p: 1800 for p in range(1, 6)}, "A1": {p: 3600 for p in range(1, 6)}}
    )
    joined = limits.attach_limits(
        _vessel_periods(spark, sf_dir), limits.limits_side_by_side(spark, [schedule])
    )
    return rounded(
        joined.groupBy("TYPE", "PERIOD", "TL_SQ", "TL_A1").agg(
            F.count("*").alias("N"), F.sum("tlbs").alias("LBS")
        )
    )


ZONE_COLUMNS = [
    "LANDING_YEAR", "LANDING_MONTH", "VESSEL_NUM", "VESSEL_REGISTRATION_ID", AGENCY, CATCH_AREA,
    "ACL_CODE", CODE, NOMINAL, LANDED, REVENUE,
]


def q_zone_limits(spark, sf_dir):
    tickets = sample_tickets(spark, sf_dir, ZONE_COLUMNS, (YEAR, YEAR))
    landed = models.zone_totals(tickets, ONE_SPECIES, "ECON", YEAR)
    zoned = groups.into_zones(landed, models.zone_tests())
    wide = limits.limits_side_by_side(spark, P.ZONE_LIMITS, label="ZONE")
    joined = limits.attach_limits(zoned, wide, ["PERIOD", "ZONE"])
    keys = ["ZONE", "PERIOD", "TL_SQ", "TL_A1", "TL_A2", "TL_A3"]
    return rounded(
        joined.groupBy(*keys).agg(F.count("*").alias("N"), F.sum("tlbs").alias("LBS"))
    )


YEAR_COLUMNS = ["LANDING_YEAR", "LANDING_MONTH", AGENCY, CATCH_AREA, COMMON, LBS]


def _area_species(tickets):
    return tickets.withColumns({"AREA": labels.area(), "SPECIES": F.col(COMMON)})


def q_year_ratio(spark, sf_dir):
    tickets = _area_species(tickets_with_gaps(spark, sf_dir, YEAR_COLUMNS))
    ratios = estimate.part_year_ratio(tickets, 8)
    # Ratios of small whole numbers are often exact ties at few digits.
    digits = {"THRU_MT": 4, "MT": 4, "RATIO": 10}
    return ratios.withColumns({name: F.round(name, n) for name, n in digits.items()})


def q_right_join_years(spark, sf_dir):
    """Tons of three years side by side, through August and whole, by vessel, area and
    species; missing keys match each other. The three sides share one scan and one sum."""
    columns = [*YEAR_COLUMNS, "VESSEL_NUM"]
    tickets = _area_species(tickets_with_gaps(spark, sf_dir, columns, (YEAR - 2, YEAR)))
    keys = ["VESSEL_NUM", "AREA", "SPECIES"]
    years = (YEAR - 2, YEAR - 1, YEAR)
    wide = estimate.years_side_by_side(tickets, years, 8, keys, complete=False)
    return rounded(wide.select(*keys, *(f"{part}_{n}" for n in "xyz" for part in ("THRU", "MT"))))


def q_right_join(spark, sf_dir):
    """Every vessel listed with its tons of one fleet, species, area and year, or 0; vessels
    without a number match each other."""
    columns = ["LANDING_YEAR", "LANDING_MONTH", "VESSEL_NUM", AGENCY, CATCH_AREA, CODE, NOMINAL, LBS]
    tickets = tickets_with_gaps(spark, sf_dir, columns, (YEAR, YEAR))
    labelled = models.strict_labels(tickets.filter(F.col(NOMINAL).isin(*ONE_SPECIES)))
    landed = labelled.filter((F.col("TYPE") == "LE") & (F.col("AREA") == "S4010"))
    landed = landed.groupBy("VESSEL_NUM").agg(sum_tons(LBS).alias("MT"))
    vessels = table(spark, sf_dir, "supplier").selectExpr(
        "if(s_suppkey % 10 = 2, null, cast(s_suppkey as string)) as VESSEL_NUM"
    )
    return rounded(fill_missing(joins.right_join(landed, vessels.distinct(), ["VESSEL_NUM"])))


def q_closest_year(spark, sf_dir):
    tickets = sample_tickets(spark, sf_dir, YEAR_COLUMNS, (YEAR - 2, YEAR))
    years = (YEAR - 2, YEAR - 1, YEAR)
    estimates = models.closest_year_model(tickets, years, species_column=COMMON)
    return rounded(flag_infinite(estimates, "ESTIMATED_MT"))


# --- totals ------------------------------------------------------------------------------


def q_vessel_totals(spark, sf_dir):
    """One fleet by two-month period, the other by month, missing pounds counted as 0."""
    tickets = tickets_with_gaps(
        spark, sf_dir,
        ["LANDING_YEAR", "LANDING_MONTH", "VESSEL_NUM", AGENCY, CATCH_AREA, CODE, NOMINAL, LBS, REVENUE],
    )
    labelled = models.strict_labels(tickets.filter(F.col(NOMINAL).isin(*ONE_SPECIES)))
    labelled = labelled.withColumn(
        "PERIOD", totals.fleet_period({"LE": "two_month", "OA": "month"})
    )
    return rounded(
        totals.vessel_totals(labelled, ["VESSEL_NUM", "LANDING_YEAR", "PERIOD", "AREA", "TYPE"])
    )


def _priced(spark, sf_dir):
    tickets = tickets_with_gaps(spark, sf_dir, ZONE_COLUMNS)
    return models.monthly_le_totals(tickets, ONE_SPECIES, "ECON")


def q_price_per_lb(spark, sf_dir):
    # Not rounded: one division of exact sums is the same number in every engine.
    return portable(flag_infinite(_priced(spark, sf_dir), "price"))


def q_mean_price(spark, sf_dir):
    means = totals.mean_price(_priced(spark, sf_dir), ["PERIOD", "SUBAREA"])
    return rounded(flag_infinite(means, "PRICE"))


def q_aggregate_cc(spark, sf_dir):
    tickets = tickets_with_gaps(spark, sf_dir, ["LANDING_YEAR", "VESSEL_NUM", NOMINAL, LANDED])
    return rounded(
        totals.sum_complete_cases(tickets, LANDED, ["LANDING_YEAR", "VESSEL_NUM", NOMINAL])
    )


def q_union_fleets(spark, sf_dir):
    """Fleets by their own period, appended and summed."""
    tickets = sample_tickets(spark, sf_dir, ["LANDING_YEAR", "LANDING_MONTH", CODE, LBS])
    labelled = tickets.withColumn("TYPE", labels.fleet())
    own = {"TYPE": "TYPE", "LANDING_YEAR": "LANDING_YEAR", LBS: LBS}
    fleets = append_subsets(
        labelled,
        [
            Subset(F.col("TYPE") == "LE", own | {"PERIOD": labels.period()}),
            Subset(F.col("TYPE") == "OA", own | {"PERIOD": F.col("LANDING_MONTH")}),
        ],
    )
    return rounded(
        fleets.groupBy("TYPE", "LANDING_YEAR", "PERIOD").agg(sum_known(LBS).alias("LBS"))
    )


def q_append_unlike(spark, sf_dir):
    """Three subsets of unlike columns under each other: two fleets, one by period and one by month, and the small lots
    of both once more, with their area."""
    tickets = tickets_with_gaps(
        spark, sf_dir, ["LANDING_YEAR", "LANDING_MONTH", "VESSEL_NUM", CODE, AGENCY, CATCH_AREA, LBS]
    )
    labelled = tickets.withColumn("TYPE", labels.fleet())
    shared = {"TYPE": "TYPE", "LANDING_YEAR": "LANDING_YEAR", LBS: LBS}
    rows = append_subsets(
        labelled,
        [
            Subset(F.col("TYPE") == "LE", {"PART": F.lit("LE")} | shared | {"PERIOD": labels.period()}),
            Subset(F.col("TYPE") == "OA", {"PART": F.lit("OA"), "VESSEL_NUM": "VESSEL_NUM"} | shared | {"MONTH": "LANDING_MONTH"}),
            Subset(F.col(LBS) < SMALL_BELOW, {"AREA": labels.area(), "PART": F.lit("SMALL")} | shared),
        ],
    )
    return counted(rows, "PART", "TYPE", "LANDING_YEAR", "PERIOD", "MONTH", "VESSEL_NUM", "AREA")


def q_distinct_species(spark, sf_dir):
    tickets = tickets_with_gaps(spark, sf_dir, [NOMINAL, COMMON])
    return tickets.select(COMMON).distinct()


def q_sorted_landings(spark, sf_dir):
    tickets = _area_species(sample_tickets(spark, sf_dir, YEAR_COLUMNS))
    keys = ["LANDING_YEAR", "AREA", "SPECIES"]
    return rounded(totals.sum_complete_cases(tickets, LBS, keys).orderBy(*keys))


# --- estimates and responses -------------------------------------------------------------


def q_partial_month(spark, sf_dir):
    tickets = sample_tickets(
        spark, sf_dir, ["LANDING_YEAR", "LANDING_MONTH", "LANDING_DAY", LBS, REVENUE]
    )
    partial = estimate.partial_month(tickets, YEAR, MONTH)
    months = tickets.groupBy("LANDING_YEAR", "LANDING_MONTH").agg(
        partial.scale_sum(F.col(LBS)).alias("LBS"), partial.scale_sum(F.col(REVENUE)).alias("REVENUE")
    )
    return rounded(months)


def q_completed_rows(spark, sf_dir):
    """Every ticket line by vessel and species, those of the month under way brought to the whole month."""
    columns = [*TICKET_DATES, "VESSEL_NUM", NOMINAL, LBS]
    tickets = tickets_with_gaps(spark, sf_dir, columns)
    partial = estimate.partial_month(tickets, YEAR, MONTH)
    whole = estimate.complete_partial_month(tickets, partial)
    small = whole.filter(F.col(LBS) < SMALL_BELOW)
    return rounded(
        small.groupBy("VESSEL_NUM", NOMINAL, "LANDING_YEAR").agg(
            F.count("*").alias("N"), exact_sum_known(LBS).alias("LBS")
        )
    )


def _responded(spark, sf_dir, rule: str, scenario: str):
    wide = limits.limits_side_by_side(spark, SAMPLE_LIMITS)
    attached = limits.attach_limits(_vessel_periods(spark, sf_dir), wide)
    rules = {scenario: {"LE": (rule, 0.8), "OA": (rule, 0.8)}}
    responded = models.respond_to(attached, rules)
    pounds = F.col(f"{scenario}LBS")
    return rounded(
        responded.groupBy("TYPE").agg(
            F.count("*").alias("N"),
            F.count_if(pounds > F.col("tlbs")).alias("N_RAISED"),
            F.count_if(pounds < F.col("tlbs")).alias("N_LOWERED"),
            sum_tons("tlbs").alias("SQ_MT"),
            sum_tons(pounds).alias("RESPONSE_MT"),
        )
    )


def q_respond_raise(spark, sf_dir):
    return _responded(spark, sf_dir, "raise", "A1")


def q_respond_cap(spark, sf_dir):
    return _responded(spark, sf_dir, "cap", "A2")


# --- trips -------------------------------------------------------------------------------


def trips_of(lines: DataFrame, headers: DataFrame, fishery: bool = True) -> DataFrame:
    """Trips with the two species side by side, from lines (by l_orderkey) and headers (by o_orderkey).

    Lines are summed per ticket first. That sum is by ticket, as is the join with the headers: at most one
    shuffle by ticket serves both, in which a ticket of however many lines is one row per map task, and
    none at all for tables that are stored by ticket.
    """
    kept = lines.filter(
        scope.outside_areas_for(
            NOMINAL, "CATCH_AREA_CODE", TRIP_SPECIES["PACIFIC_HALIBUT"], P.HALIBUT_EXCLUDED_AREAS
        )
    )
    per_ticket = trips.species_side_by_side(
        kept, TRIP_SPECIES, keys=["l_orderkey"], species_column=NOMINAL
    )
    if fishery:
        headers = headers.filter(models.in_trip_fishery())
    joined = per_ticket.join(headers, F.col("l_orderkey") == F.col("o_orderkey"))
    return trips.roll_up(joined, list(TRIP_SPECIES))


def sample_trips(spark: SparkSession, sf_dir: str, years=None, fishery: bool = True) -> DataFrame:
    """Trips from lines and headers as they come."""
    return trips_of(sample_trip_lines(spark, sf_dir), sample_trip_headers(spark, sf_dir, years), fishery)


def stored_trip_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines and headers stored by ticket: written when a session first asks for them, read from then on."""
    names = [f"trip_{part}_{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}" for part in ("lines", "headers")]
    lines, headers = (stored(spark, name) for name in names)
    if lines is None or headers is None:
        rows = table(spark, sf_dir, "lineitem").count()
        buckets = buckets_for(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
        lines = store_by_ticket(
            sample_trip_lines(spark, sf_dir), names[0], "l_orderkey", buckets,
            {LANDED: F.sum(LANDED)}, ["CATCH_AREA_CODE", NOMINAL],
        )
        headers = store_by_ticket(sample_trip_headers(spark, sf_dir), names[1], "o_orderkey", buckets)
    return lines, headers


def stored_trips(spark: SparkSession, sf_dir: str, years=None, fishery: bool = True) -> DataFrame:
    """Trips from tables stored by ticket: no line moves."""
    lines, headers = stored_trip_tables(spark, sf_dir)
    if years is not None:
        headers = headers.filter(F.col("LANDING_YEAR").between(*years))
    return trips_of(lines, headers, fishery)


def q_trip_pivot(spark, sf_dir):
    wide = sample_trips(spark, sf_dir, fishery=False)
    net = trips.net_weight("PACIFIC_HALIBUT").alias("PACIFIC_HALIBUT_NET")
    return rounded(wide.select("*", net))


def q_step_round(spark, sf_dir):
    stepped = sample_trips(spark, sf_dir, fishery=False).withColumn(
        "STEPPED", respond.step_round("SABLEFISH")
    )
    return rounded(stepped.groupBy("SABLEFISH", "STEPPED").agg(F.count("*").alias("N")))


def q_ratio_limit(spark, sf_dir):
    wide = sample_trips(spark, sf_dir, fishery=False).filter(
        (F.col("PACIFIC_HALIBUT") > 0) & (F.col("SABLEFISH") > 0)
    )
    limited = trips.with_ratio_limits(wide, "SABLEFISH", P.RATIO_LIMITS)
    return rounded(
        trips.respond_to_ratio_limits(
            limited, "PACIFIC_HALIBUT", list(P.RATIO_LIMITS), P.RATIO_BASE
        )
    )


def _net_halibut(spark, sf_dir, keys, years=None, divisor=1.0, source=sample_trips):
    season = source(spark, sf_dir, years).filter(trips.in_months(4, 10))
    return rounded(trips.net_pounds(season, "PACIFIC_HALIBUT", keys, divisor))


def q_month_profile(spark, sf_dir, source=sample_trips):
    return _net_halibut(spark, sf_dir, ["LANDING_YEAR", "LANDING_MONTH"], source=source)


def q_month_gross(spark, sf_dir, source=sample_trips):
    """Gross pounds of both species by month of the current year."""
    season = source(spark, sf_dir, (YEAR, YEAR)).filter(trips.in_months(4, 10))
    return rounded(trips.gross_pounds(season, list(TRIP_SPECIES), ["LANDING_MONTH"]))


def q_month_average(spark, sf_dir, source=sample_trips):
    """Average month of four complete years."""
    return _net_halibut(spark, sf_dir, ["LANDING_MONTH"], (1996, 1999), 4, source)


def q_year_breakdown(spark, sf_dir, source=sample_trips):
    return _net_halibut(spark, sf_dir, ["LANDING_YEAR"], (1996, 1999), source=source)


def q_year_to_date(spark, sf_dir, source=sample_trips):
    """Landings through August, and those of the months that remained a year before, added
    by year."""
    season = source(spark, sf_dir).filter(trips.in_months(4, 10))
    early = F.col("LANDING_MONTH") <= 8
    year = F.when(early, F.col("LANDING_YEAR")).otherwise(F.col("LANDING_YEAR") + 1)
    halibut = F.col("PACIFIC_HALIBUT")
    sums = season.groupBy(year.alias("LANDING_YEAR")).agg(
        sum_known(F.when(early, halibut)).alias("SO_FAR_LBS"),
        sum_known(F.when(~early, halibut)).alias("REST_LBS"),
    )
    total = trips.net_weight(F.col("SO_FAR_LBS") + F.col("REST_LBS")).alias("NET_LBS")
    return rounded(sums.select("*", total))


# --- models ------------------------------------------------------------------------------

LINGCOD_COLUMNS = [
    "LANDING_YEAR", "LANDING_MONTH", "VESSEL_NUM", AGENCY, CATCH_AREA, CODE, NOMINAL,
    "MANAGEMENT_GROUP_CODE", LBS, REVENUE,
]
LINGCOD_SCOPE = {"species": ONE_SPECIES, "group": "ECON", "prior_year": PRIOR}


def q_model_lingcod(spark, sf_dir):
    tickets = sample_tickets(spark, sf_dir, LINGCOD_COLUMNS, (PRIOR, YEAR))
    return rounded(models.lingcod_model(tickets, **LINGCOD_SCOPE))


def q_in_season(spark, sf_dir):
    tickets = sample_tickets(spark, sf_dir, LINGCOD_COLUMNS, (PRIOR, YEAR))
    return rounded(
        models.lingcod_model(tickets, in_season=True, by=("TYPE", "SECTOR"), **LINGCOD_SCOPE)
    )


def q_bycatch(spark, sf_dir):
    """Bycatch of all landings by fleet and year under each region's depth bins."""
    periods = _vessel_periods(spark, sf_dir)
    projected = totals.project_tons(periods, ["TYPE", "LANDING_YEAR"], {"SQ_MT": "tlbs"})
    bins = bycatch.bin_table(spark, P.DEPTH_BINS)
    both = bycatch.bycatch_tons(projected, bins, "OR", {"OR_MT": "SQ_MT"})
    both = bycatch.bycatch_tons(both, bins, "ncal", {"NCAL_MT": "SQ_MT"})
    return rounded(bycatch.extra_bycatch(both, "OR_MT", {"EXTRA_MT": "NCAL_MT"}), 6)


TICKET_DATES = ["LANDING_YEAR", "LANDING_MONTH", "LANDING_DAY"]
POP_COLUMNS = [*TICKET_DATES, "VESSEL_NUM", AGENCY, CATCH_AREA, CODE, NOMINAL, LBS, REVENUE]


def q_model_pop(spark, sf_dir):
    tickets = sample_tickets(
        spark, sf_dir, POP_COLUMNS, (YEAR, YEAR), codes=labels.LIMITED_ENTRY_CODES
    )
    dates = sample_tickets(spark, sf_dir, TICKET_DATES, (YEAR, YEAR))
    return rounded(
        models.pop_model(
            tickets, species=ONE_SPECIES, year=YEAR, partial_month=MONTH, day_source=dates
        )
    )


def q_model_yellowtail(spark, sf_dir):
    columns = [c for c in POP_COLUMNS if c != "LANDING_DAY"]
    tickets = sample_tickets(spark, sf_dir, columns, (YEAR, YEAR))
    return rounded(models.yellowtail_model(tickets, species=ONE_SPECIES, year=YEAR))


def q_model_shelf(spark, sf_dir):
    columns = [*LINGCOD_COLUMNS, COMMON, "PARTICIPATION_GROUP_CODE", "COUNCIL_CODE"]
    tickets = sample_tickets(spark, sf_dir, columns, (PRIOR, YEAR))
    return rounded(
        models.shelf_model(
            tickets, species=SHELF_NAMES, years=(PRIOR, YEAR), species_column=COMMON
        )
    )


def q_model_shelf_all(spark, sf_dir):
    """Both years and every area, without the rolling year."""
    columns = [*LINGCOD_COLUMNS, COMMON, "PARTICIPATION_GROUP_CODE", "COUNCIL_CODE"]
    tickets = sample_tickets(spark, sf_dir, columns, (PRIOR, YEAR))
    return rounded(
        models.shelf_model(
            tickets, species=SHELF_NAMES, years=(PRIOR, YEAR), last_month=None, area=None,
            species_column=COMMON,
        )
    )


def q_result_text(spark, sf_dir):
    """A model's result as it is written: text in fixed notation."""
    columns = [c for c in POP_COLUMNS if c != "LANDING_DAY"]
    tickets = sample_tickets(spark, sf_dir, columns, (YEAR, YEAR))
    return as_text(models.yellowtail_model(tickets, species=ONE_SPECIES, year=YEAR), digits=4)


NUMBERED_KEYS = ["LANDING_YEAR", "VESSEL_NUM", "PERIOD", "TYPE"]


def q_result_numbered(spark, sf_dir):
    """Totals by vessel and period in order, with their row names; a tenth of the vessels has no number."""
    tickets = tickets_with_gaps(spark, sf_dir, ["LANDING_YEAR", "LANDING_MONTH", "VESSEL_NUM", CODE, LBS])
    labelled = tickets.withColumns({"PERIOD": labels.period(), "TYPE": labels.fleet()})
    landed = labelled.groupBy(*NUMBERED_KEYS).agg(sum_known(LBS).alias("LBS"))
    return rounded(row_numbered(landed, NUMBERED_KEYS))


def q_result_file(spark, sf_dir):
    """Sorted landings written with row names and read back: each row's name, and its place in the files."""
    tickets = _area_species(tickets_with_gaps(spark, sf_dir, YEAR_COLUMNS))
    keys = ["LANDING_YEAR", "AREA", "SPECIES"]
    landed = tickets.groupBy(*keys).agg(sum_known(LBS).alias(LBS))
    path = new_folder(spark, "result")
    write_result(landed, path, order=keys, row_names=True)
    return rounded(read_result(spark, path, landed.schema, row_names=True))


def q_widow_shelf(spark, sf_dir):
    tickets = sample_tickets(spark, sf_dir, POP_COLUMNS, (YEAR, YEAR))
    dates = sample_tickets(spark, sf_dir, TICKET_DATES, (YEAR, YEAR))
    return rounded(
        models.widow_shelf_model(
            tickets, members=WIDOW_GROUPS, year=YEAR, partial_month=MONTH, day_source=dates
        )
    )


def q_ns_landings(spark, sf_dir):
    columns = [*TICKET_DATES, AGENCY, CATCH_AREA, CODE, "REGION_NAME", "SUBREGION_NAME", COMMON, LBS, REVENUE]
    tickets = tickets_with_gaps(spark, sf_dir, columns, (YEAR, YEAR))
    return rounded(
        models.nearshore_landings(
            tickets, YEAR, MONTH, NEARSHORE_NAMES, SMALL_NAME, SMALL_BELOW,
            NEARSHORE_SAMPLE_RULES, COMMON,
        )
    )


def q_model_zones(spark, sf_dir):
    tickets = sample_tickets(spark, sf_dir, ZONE_COLUMNS, (YEAR, YEAR))
    return rounded(models.zones_model(tickets, species=ONE_SPECIES, group="ECON", year=YEAR))


# Limits amid the sample landings, so that each zone has rows on either side of each rule.
SAMPLE_ZONES = tuple(
    LimitSchedule(zone, "two_month", {"SQ": 2000, "A1": 2600, "A2": 1500})
    for zone in ("LEN", "LES", "LESS", "OAN", "OAS", "OASS")
)
SAMPLE_ZONE_RULES = {
    "A1": {s.label: ("raise", 0.8) for s in SAMPLE_ZONES},
    "A2": {s.label: ("cap", 0.6) for s in SAMPLE_ZONES},
}


def q_zone_branches(spark, sf_dir):
    """All six zones under a raised and a lowered limit, with the rows that each rule moved."""
    tickets = sample_tickets(spark, sf_dir, ZONE_COLUMNS, (YEAR, YEAR))
    responded = models.zone_responses(
        tickets, SAMPLE_ZONES, SAMPLE_ZONE_RULES, species=ONE_SPECIES, group="ECON", year=YEAR
    )
    counts = []
    for name in SAMPLE_ZONE_RULES:
        moved = F.col(f"{name}LBS") - F.col("tlbs")
        counts += [
            F.count_if(moved > 0).alias(f"{name}_RAISED"),
            F.count_if(moved < 0).alias(f"{name}_LOWERED"),
            F.count_if(moved == 0).alias(f"{name}_KEPT"),
            sum_tons(f"{name}LBS").alias(f"{name}_MT"),
        ]
    return rounded(responded.groupBy("ZONE").agg(sum_tons("tlbs").alias("SQ_MT"), *counts))


def q_model_zones_monthly(spark, sf_dir):
    tickets = sample_tickets(spark, sf_dir, ZONE_COLUMNS, (YEAR, YEAR))
    return rounded(
        models.zones_model(
            tickets, monthly_totals=True, species=ONE_SPECIES, group="ECON", year=YEAR
        )
    )


def q_model_zones_monthly_limits(spark, sf_dir):
    """The open access fleet under the monthly limits considered, totalled by month."""
    tickets = sample_tickets(spark, sf_dir, ZONE_COLUMNS, (YEAR, YEAR))
    return rounded(
        models.zones_model(
            tickets, P.ZONE_LIMITS_MONTHLY_OA, species=ONE_SPECIES, group="ECON", year=YEAR
        )
    )


def q_model_ratio(spark, sf_dir, source=sample_trips):
    season = source(spark, sf_dir, (PRIOR, YEAR)).filter(trips.in_months(4, 10))
    # The sample orders end in July, so the months through June count as landed.
    return rounded(models.ratio_model(season, PRIOR, YEAR, last_actual_month=6))


def _from_stored(query):
    """The same query over lines and headers that are stored by ticket."""
    return lambda spark, sf_dir: query(spark, sf_dir, source=stored_trips)


q_stored_month_profile = _from_stored(q_month_profile)
q_stored_month_gross = _from_stored(q_month_gross)
q_stored_month_average = _from_stored(q_month_average)
q_stored_year_breakdown = _from_stored(q_year_breakdown)
q_stored_year_to_date = _from_stored(q_year_to_date)
q_stored_model_ratio = _from_stored(q_model_ratio)


def q_model_incidental(spark, sf_dir):
    """The trip model over flat tickets: header and line columns filter at the scan."""
    columns = [
        "LANDING_YEAR", "LANDING_MONTH", "LANDING_DATE", "VESSEL_NUM", AGENCY, "CATCH_AREA_CODE",
        "GMT_SABLEFISH_CODE", "REMOVAL_TYPE_CODE", NOMINAL, LANDED,
    ]
    # Five vessels, so that trips hold several lines of both species.
    few = {"VESSEL_NUM": "cast(l_suppkey % 5 as string)"}
    tickets = sample_tickets(spark, sf_dir, columns, (PRIOR, YEAR), overrides=few)
    return rounded(
        models.incidental_projection(
            tickets, TRIP_SPECIES, NOMINAL, agency="C", fisheries=("PRI", "LEN", "OPN"),
            reference_year=PRIOR, current_year=YEAR, last_actual_month=8,
        )
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: value for name, value in globals().items() if name.startswith("q_")}
