"""Completion of a year under way, bycatch, and joins on missing keys."""

import math

import pytest
from pyspark.sql import functions as F

from harborline.functions.units import POUNDS_PER_METRIC_TON
from harborline.operators import bycatch, estimate, joins, totals
from harborline.plans.parameters import DEPTH_BINS


def test_partial_month(spark):
    df = spark.createDataFrame(
        [(2001, 11, 2, 400.0), (2001, 11, 4, 0.0), (2001, 10, 30, 100.0), (2000, 11, 4, 50.0)],
        "LANDING_YEAR int, LANDING_MONTH int, LANDING_DAY int, ROUND_WEIGHT_LBS double",
    )
    november = estimate.partial_month(df, 2001, 11)
    got = estimate.complete_partial_month(df, november).collect()
    assert [r.ROUND_WEIGHT_LBS for r in got] == [3000.0, 0.0, 100.0, 50.0]
    pounds = F.col("ROUND_WEIGHT_LBS")
    assert df.agg(november.scale_sum(pounds)).collect()[0][0] == 3150.0
    no_rows = estimate.partial_month(df, 1999, 12)
    got = estimate.complete_partial_month(df, no_rows).collect()
    assert [r.ROUND_WEIGHT_LBS for r in got] == [400.0, 0.0, 100.0, 50.0]
    assert df.agg(no_rows.scale_sum(pounds)).collect()[0][0] == 550.0


def test_scaled_sums_are_exact(spark):
    """Seven landings of 120 in seven of thirty days are 3600, a limit, not just below it."""
    df = spark.createDataFrame(
        [(2001, 11, day, 120.0) for day in range(1, 8)],
        "LANDING_YEAR int, LANDING_MONTH int, LANDING_DAY int, ROUND_WEIGHT_LBS double",
    )
    november = estimate.partial_month(df, 2001, 11)
    assert df.agg(november.scale_sum(F.col("ROUND_WEIGHT_LBS"))).collect()[0][0] == 3600.0
    assert sum(120.0 * 30 / 7 for _ in range(7)) != 3600.0


def lines(year, early, late):
    """Pounds that weigh the given tons, in March and in October."""
    lb = POUNDS_PER_METRIC_TON
    return [(year, 3, "N", "S", early * lb), (year, 10, "N", "S", late * lb)]


@pytest.mark.parametrize(
    "x, y, z, expected",
    [
        ((80, 20), (50, 50), (75, 0), 93.75),
        ((80, 20), (70, 70), (75, 0), 150.0),
        ((75, 0), (10, 90), (75, 5), 80.0),
        ((0, 100), (0, 100), (75, 0), math.inf),
        ((0, 100), (0, 100), (0, 0), None),
    ],
)
def test_closest_year(spark, x, y, z, expected):
    rows = lines(1, *x) + lines(2, *y) + lines(3, *z)
    df = spark.createDataFrame(
        rows, "LANDING_YEAR int, LANDING_MONTH int, AREA string, SPECIES string, ROUND_WEIGHT_LBS double"
    )
    wide = estimate.years_side_by_side(df, (1, 2, 3), 8)
    got = estimate.closest_year_estimate(wide).collect()[0].ESTIMATED_MT
    assert got == expected if expected in (None, math.inf) else got == pytest.approx(expected)


@pytest.mark.parametrize("x, y, z", [(519721, 521281, 520501), (1000001, 1000003, 1000002), (7, 13, 10)])
def test_a_tie_in_whole_pounds_takes_the_second_year(spark, x, y, z):
    rows = [(1, 3, "N", "S", float(x)), (2, 3, "N", "S", float(y)), (2, 10, "N", "S", float(y)), (3, 3, "N", "S", float(z))]
    df = spark.createDataFrame(
        rows, "LANDING_YEAR int, LANDING_MONTH int, AREA string, SPECIES string, ROUND_WEIGHT_LBS double"
    )
    (got,) = estimate.closest_year_estimate(estimate.years_side_by_side(df, (1, 2, 3), 8)).collect()
    assert got.RATIO == 0.5
    assert got.ESTIMATED_MT == pytest.approx(2 * z / POUNDS_PER_METRIC_TON)


def test_missing_keys_stay_where_asked(spark):
    rows = [(2, 3, None, "S", 5.0), (3, 3, None, "S", None), (3, 9, "N", None, 7.0)]
    df = spark.createDataFrame(
        rows, "LANDING_YEAR int, LANDING_MONTH int, AREA string, SPECIES string, ROUND_WEIGHT_LBS double"
    )
    wide = estimate.years_side_by_side(df, (1, 2, 3), 8, complete=False).collect()
    assert {(r.AREA, r.SPECIES): (r.LBS_y, r.THRU_LBS_z, r.LBS_z) for r in wide} == {
        (None, "S"): (5.0, 0.0, 0.0), ("N", None): (0.0, 0.0, 7.0),
    }


def test_first_year_needs_the_second(spark):
    rows = lines(1, 80, 20) + lines(3, 75, 0) + [(2, 3, "N", "other", 5.0)]
    df = spark.createDataFrame(
        rows, "LANDING_YEAR int, LANDING_MONTH int, AREA string, SPECIES string, ROUND_WEIGHT_LBS double"
    )
    got = estimate.years_side_by_side(df, (1, 2, 3), 8).collect()
    assert len(got) == 1
    assert (got[0].SPECIES, got[0].THRU_x, got[0].MT_x, got[0].RATIO_x) == ("S", 0.0, 0.0, 0.0)
    assert got[0].MT_z == pytest.approx(75)


def test_part_year_ratio(spark):
    df = spark.createDataFrame(
        lines(1, 80, 20) + [(2, 10, "N", "S", 2204.6), (3, 1, "N", "S", 0.0), (4, 1, None, "S", 1.0)],
        "LANDING_YEAR int, LANDING_MONTH int, AREA string, SPECIES string, ROUND_WEIGHT_LBS double",
    )
    got = {r.LANDING_YEAR: r for r in estimate.part_year_ratio(df, 8).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].RATIO == pytest.approx(0.8)
    assert (got[2].THRU_MT, got[2].RATIO) == (0.0, 0.0)
    assert math.isnan(got[3].RATIO)


def test_bycatch(spark):
    df = spark.createDataFrame([("LE", 1000.0, 2000.0)], "TYPE string, SQ double, A1 double")
    bins = bycatch.bin_table(spark, DEPTH_BINS)
    got = bycatch.bycatch_tons(df, bins, "OR", {"b0": "SQ", "b1": "A1"})
    got = bycatch.extra_bycatch(got, "b0", {"extra": "b1"}).collect()[0]
    assert got.b0 == pytest.approx(8.882069)
    assert got.extra == pytest.approx(8.882069)
    other = bycatch.bycatch_tons(df, bins, "ncal", {"b": "SQ"}).collect()[0]
    assert other.b == pytest.approx(11.789642, abs=5e-7)


def test_right_join_matches_missing_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20), ("c", 30)], "k string, y int")
    got = {r.k: (r.x, r.y) for r in joins.right_join(left, right, ["k"]).collect()}
    assert got == {None: (1, 10), "a": (2, 20), "c": (None, 30)}


def test_price(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 0.0), ("b", 5.0, 0.0), ("c", 6.0, 2.0)], "v string, exvessel double, tlbs double"
    )
    got = {r.v: r.price for r in totals.with_price(df).collect()}
    assert got == {"b": math.inf, "c": 3.0}


def test_incomplete_rows_do_not_sum(spark):
    df = spark.createDataFrame(
        [("t1", 5.0), ("t1", None), ("t2", None), (None, 3.0)], "trip string, lbs double"
    )
    got = totals.sum_complete_cases(df, "lbs", ["trip"]).collect()
    assert [tuple(r) for r in got] == [("t1", 5.0)]


def test_vessel_totals_keep_groups_without_pounds(spark):
    df = spark.createDataFrame(
        [("a", None, None), (None, 1.0, 1.0), ("b", 2.0, 3.0)],
        "VESSEL_NUM string, ROUND_WEIGHT_LBS double, EXVESSEL_REVENUE double",
    )
    got = {r.VESSEL_NUM: (r.exvessel, r.tlbs) for r in totals.vessel_totals(df, ["VESSEL_NUM"]).collect()}
    assert got == {"a": (0.0, 0.0), "b": (3.0, 2.0)}
