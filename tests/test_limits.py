"""Limit tables and their joins."""

import pytest

from harborline.operators import limits as L
from harborline.operators.limits import LimitSchedule
from harborline.operators.tables import parameter_table
from harborline.plans import parameters as P


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_flat_listed_and_partial_limits():
    s = LimitSchedule("LE", "two_month", {"SQ": 5, "A1": (1, 2, 3, 4, 5, 6), "A2": {2: 7}})
    assert s.by_period("SQ") == {p: 5.0 for p in range(1, 7)}
    assert s.by_period("A1")[6] == 6.0
    assert s.by_period("A2") == {2: 7.0}
    assert s.by_period("A3") == {}


def test_wrong_number_of_periods():
    with pytest.raises(ValueError):
        LimitSchedule("LE", "month", {"SQ": (1, 2, 3, 4, 5, 6)}).by_period("SQ")
    with pytest.raises(ValueError):
        LimitSchedule("LE", "two_month", {"SQ": {7: 1}}).by_period("SQ")


def test_grain_mismatch_is_refused():
    with pytest.raises(ValueError):
        L.check_grain(P.LINGCOD_LIMITS, {"OA": "two_month"})
    L.check_grain(P.LINGCOD_LIMITS, {"OA": "month", "LE": "two_month"})


def test_long_and_wide_agree(spark):
    long = L.limit_table(spark, P.ZONE_LIMITS, "ZONE")
    wide = L.limits_side_by_side(spark, P.ZONE_LIMITS, "ZONE")
    widened = L.widen_limits(long, ["SQ", "A1", "A2", "A3"], "ZONE")
    assert rows(wide, "ZONE", "PERIOD") == rows(widened, "ZONE", "PERIOD")
    assert wide.count() == 5 * 6


def test_wide_equals_full_outer_chain(spark):
    schedule = LimitSchedule("LE", "month", {"SQ": {1: 10, 2: 20}, "A1": {2: 22, 5: 55}, "A2": 7})
    parts = [
        L.limits_side_by_side(spark, [LimitSchedule("LE", "month", {k: v})]).drop("TYPE")
        for k, v in schedule.pounds.items()
    ]
    chained = L.full_outer_chain(parts, ["PERIOD"]).select("PERIOD", "TL_SQ", "TL_A1", "TL_A2")
    wide = L.limits_side_by_side(spark, [schedule]).select("PERIOD", "TL_SQ", "TL_A1", "TL_A2")
    assert rows(wide, "PERIOD") == rows(chained, "PERIOD")
    assert rows(wide, "PERIOD")[4] == (5, None, 55.0, 7.0)


def test_unmatched_landings_drop_out(spark):
    totals = spark.createDataFrame(
        [(1, "LE", 5.0), (1, "OA", 6.0), (7, "LE", 7.0)], "PERIOD int, TYPE string, tlbs double"
    )
    joined = L.attach_limits(totals, L.limits_side_by_side(spark, P.POP_LIMITS))
    assert [(r.PERIOD, r.TYPE, r.tlbs, r.TL_SQ, r.TL_A1) for r in joined.collect()] == [
        (1, "LE", 5.0, 1800.0, 3600.0)
    ]


def test_parameter_tables_have_any_length_and_no_hint(spark):
    long = L.limit_table(spark, P.POP_LIMITS)
    many = parameter_table(spark, long.schema, [("LE", "month", 1, "SQ", float(i)) for i in range(30_000)])
    assert many.count() == 30_000 and "ResolvedHint" not in many._jdf.queryExecution().analyzed().toString()
