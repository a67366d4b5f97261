"""Row filters, species groups, periods and trips: hand-worked rows."""

import pytest

from harborline.functions import labels
from harborline.operators import groups, scope, totals, trips
from harborline.plans.parameters import (
    HALIBUT_EXCLUDED_AREAS,
    LAST_ACTUAL,
    LINGCOD_LIMITS,
    SMALL_SPECIES,
    SMALL_SPECIES_BELOW,
    WIDOW_AND_SHELF_GROUPS,
)


def test_rolling_year(spark):
    # Month 8 ends the fourth two-month period.
    rows = [
        (kind, year, month) for kind in ("LE", "OA") for year in (2021, 2022, 2023, 2024) for month in range(1, 13)
    ]
    df = spark.createDataFrame(rows, "TYPE string, LANDING_YEAR int, LANDING_MONTH int")
    last = scope.last_months(LAST_ACTUAL, {s.label: s.grain for s in LINGCOD_LIMITS})
    assert last == {"LE": 8, "OA": 9}
    got = {tuple(r) for r in df.filter(scope.rolling_year(2022, last)).collect()}
    expected = {
        (kind, year, month)
        for kind, year, month in rows
        if year == 2022 and month > last[kind] or year == 2023 and month <= last[kind]
    }
    assert got == expected and len(got) == 24


def test_rolling_year_of_an_unknown_fleet(spark):
    df = spark.createDataFrame([("XX", 2022, 12), (None, 2023, 1)], "TYPE string, LANDING_YEAR int, LANDING_MONTH int")
    assert df.filter(scope.rolling_year(2022, {"LE": 8})).count() == 0
    assert df.filter(scope.rolling_year(2022, 10)).count() == 2


def test_fleet_period(spark):
    df = spark.createDataFrame([("LE", 7), ("OA", 7), ("LE", 12), ("XX", 1), (None, 1)], "TYPE string, LANDING_MONTH int")
    column = totals.fleet_period({"LE": "two_month", "OA": "month"})
    assert [r[0] for r in df.select(column).collect()] == [4, 7, 6, None, None]


def test_small_landings_of_one_species(spark):
    rows = [(SMALL_SPECIES, 109.0), (SMALL_SPECIES, 110.0), ("LINGCOD", 500.0), ("SABLEFISH", 1.0), (None, 1.0), (SMALL_SPECIES, None)]
    df = spark.createDataFrame(rows, "s string, lbs double")
    test = scope.listed_or_small("s", "lbs", ["LINGCOD"], SMALL_SPECIES, SMALL_SPECIES_BELOW)
    assert [tuple(r) for r in df.filter(test).collect()] == [rows[0], rows[2]]


def test_area_binds_one_species(spark):
    rows = [
        ("PACIFIC HALIBUT", "60A2"), ("PACIFIC HALIBUT", "61"), ("PACIFIC HALIBUT", "59A1"),
        ("PACIFIC HALIBUT", None), ("SABLEFISH", "61"), ("SABLEFISH", None), (None, "59A1"),
    ]
    df = spark.createDataFrame(rows, "s string, a string")
    test = scope.outside_areas_for("s", "a", "PACIFIC HALIBUT", HALIBUT_EXCLUDED_AREAS)
    assert [tuple(r) for r in df.filter(test).collect()] == [rows[2], rows[4], rows[5]]


def test_overlapping_groups(spark):
    df = spark.createDataFrame([("WIDOW ROCKFISH", 10.0), ("BOCACCIO", 4.0), ("LINGCOD", 9.0), (None, 1.0)], "s string, lbs double")
    membership = groups.membership_table(spark, WIDOW_AND_SHELF_GROUPS, "s")
    got = dict(groups.into_groups(df, membership, "s").groupBy("SPPGROUP").sum("lbs").collect())
    assert got == {"WIDOW&SHELF": 14.0, "SHELF": 4.0, "WIDOW": 10.0}


def test_zones_may_overlap(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int").withColumn("one", labels.period("x"))
    zones = {"low": df.x < 3, "high": df.x > 1, "none": df.x > 9}
    got = [(r.x, r.ZONE) for r in groups.into_zones(df, zones).orderBy("x", "ZONE").collect()]
    assert got == [(1, "low"), (2, "high"), (2, "low"), (3, "high")]


TRIP = "day string, vessel string, species string, lbs double"
NAMES = {"H": "PACIFIC HALIBUT", "S": "SABLEFISH"}


def side_by_side(spark, rows):
    df = spark.createDataFrame(rows, TRIP)
    wide = trips.species_side_by_side(df, NAMES, ["day", "vessel"], "species", "lbs")
    return {(r.day, r.vessel): (r.H, r.S) for r in wide.collect()}


def test_species_side_by_side(spark):
    got = side_by_side(
        spark,
        [
            ("1", "a", "PACIFIC HALIBUT", 5.0), ("1", "a", "PACIFIC HALIBUT", None),
            ("1", "a", "SABLEFISH", 7.0), ("2", "a", "SABLEFISH", 1.0),
            ("3", "a", "SABLEFISH", None), ("4", None, "SABLEFISH", 2.0),
            ("5", "a", "LINGCOD", 3.0), ("6", "a", None, 3.0),
            ("7", "a", "SABLEFISH", float("nan")),
        ],
    )
    assert got == {("1", "a"): (5.0, 7.0), ("2", "a"): (0.0, 1.0)}


def test_conditional_sums_equal_a_pivot(spark):
    rows = [(str(i % 7), str(i % 3), list(NAMES.values())[i % 5 % 2], float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, TRIP)
    pivot = df.groupBy("day", "vessel").pivot("species", list(NAMES.values())).sum("lbs").fillna(0)
    expected = {(r[0], r[1]): (r[2], r[3]) for r in pivot.collect()}
    assert side_by_side(spark, rows) == expected


def test_tickets_roll_up_to_trips(spark):
    rows = [("1", "a", "PACIFIC HALIBUT", 5.0), ("1", "b", "SABLEFISH", 7.0), ("2", "a", "SABLEFISH", 1.0)]
    df = spark.createDataFrame(rows, TRIP)
    by_ticket = trips.species_side_by_side(df, NAMES, ["day", "vessel"], "species", "lbs")
    rolled = trips.roll_up(by_ticket, list(NAMES), ["day"])
    assert {r.day: (r.H, r.S) for r in rolled.collect()} == {"1": (5.0, 7.0), "2": (0.0, 1.0)}


def test_net_pounds_and_average(spark):
    df = spark.createDataFrame([(1, 100.0), (1, 300.0), (2, 50.0)], "m int, H double")
    got = dict(trips.net_pounds(df, "H", ["m"], 4).collect())
    assert got == {1: pytest.approx(88.0), 2: pytest.approx(11.0)}
