"""Labels against hand-worked rows."""

import pytest
from pyspark.sql import functions as F

from harborline.functions import labels as L
from harborline.plans.parameters import NEARSHORE_RULES


def label(spark, rows, names, column):
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.select(column).collect()]


def test_period(spark):
    df = spark.createDataFrame([(m,) for m in range(1, 13)], "LANDING_MONTH int")
    got = [r[0] for r in df.select(L.period()).collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6]


CODES = [("05",), ("5",), (" 7 ",), ("08",), ("8",), ("10",), ("04",), ("005",), ("",), (None,)]


@pytest.mark.parametrize(
    "column, expected",
    [
        (L.fleet, ["LE", "LE", "LE", "OA", "OA", "OA", None, None, None, None]),
        (L.fleet_or_default, ["LE", "LE", "LE", "OA", "OA", "OA", "OA", "OA", "OA", None]),
        (L.sector, ["NS", "NS", "NON-NS", "NON-NS", "NON-NS", "NON-NS", None, None, None, None]),
        (L.nearshore_only, ["NS", "NS"] + [None] * 8),
    ],
)
def test_code_labels(spark, column, expected):
    assert label(spark, CODES, ["DAHL_GROUNDFISH_CODE"], column()) == expected


def test_sector_code_keeps_long_codes(spark):
    rows = [("5",), (" 05 ",), ("10",), ("123",), (None,)]
    assert label(spark, rows, ["c"], L.sector_code("c")) == ["05", "05", "10", "123", None]


def test_sector_by_state(spark):
    rows = [("07", "O"), ("05", "O"), ("5", "W"), ("05", None), ("07", None), (None, "O")]
    got = label(spark, rows, ["DAHL_GROUNDFISH_CODE", "AGENCY_CODE"], L.sector_by_state())
    assert got == ["NON_NS", "OR_NS", "CAL_NS", None, "NON_NS", None]


AREAS = [("O", None), ("C", "1C"), ("C", "1B"), ("C", None), ("X", "1C"), ("X", "1B"), (None, "1C")]


@pytest.mark.parametrize(
    "column, expected",
    [
        (L.area, ["N4010", "N4010", "S4010", None, None, None, None]),
        (L.area_or_default, ["N4010", "N4010", "S4010", None, "N4010", "S4010", None]),
        (L.subarea, ["N42", "4010_42", "S4010", None, "4010_42", "S4010", None]),
    ],
)
def test_areas(spark, column, expected):
    assert label(spark, AREAS, ["AGENCY_CODE", "PACFIN_CATCH_AREA_CODE"], column()) == expected


def test_subarea_by_stock(spark):
    rows = [
        ("O", "1A", "SSPN_S"), ("C", "1B", "SSPN_N"), ("C", "1C", "SSPN_N"), ("C", "1B", None),
        ("W", None, None), ("C", "1C", None), (None, None, "SSPN_S"), (None, "1C", "SSPN_N"),
    ]
    got = label(
        spark, rows, ["AGENCY_CODE", "PACFIN_CATCH_AREA_CODE", "ACL_CODE"], L.subarea_by_stock()
    )
    assert got == [
        "South of 3427", "3427-4010", "4010-42", None, "N42", "4010-42", "South of 3427", None,
    ]


def test_subarea_by_port(spark):
    rows = [
        ("SOUTH CALIFORNIA", "SAN DIEGO"), ("SOUTH CALIFORNIA", "SAN LUIS OBISPO"), (None, "x"),
        ("SOUTH CALIFORNIA", None), ("OREGON", "x"),
    ]
    got = label(spark, rows, ["REGION_NAME", "SUBREGION_NAME"], L.subarea_by_port())
    assert got == ["S3427", "N3427", "N3427", "N3427", "N3427"]


def test_species_group(spark):
    rows = [("LINGCOD",), ("SABLEFISH",), (None,)]
    strict = L.species_group("s", ["LINGCOD"], "LING")
    blank = L.species_group_or_blank("s", ["LINGCOD"], "LING")
    assert label(spark, rows, ["s"], strict) == ["LING", None, None]
    assert label(spark, rows, ["s"], blank) == ["LING", "", None]


def test_species_group_by_rules(spark):
    rows = [
        ("BLUE ROCKFISH", "C"), ("BLUE ROCKFISH", "O"), ("CABEZON", "O"), ("CABEZON", "C"),
        ("CANARY ROCKFISH", "W"), ("CANARY ROCKFISH", "O"), ("LINGCOD", "C"), ("LINGCOD", None),
        ("BLUE ROCKFISH", None), ("CHINA ROCKFISH", None), (None, "O"),
    ]
    got = label(spark, rows, ["s", "a"], L.species_group_by_rules("s", "a", NEARSHORE_RULES))
    assert got == [
        "NEARSHORE", "BLACK/BLUE/DEACON ROCKFISH", "CABEZON/KELP GREENLING", "CABEZON",
        "CANARY ROCKFISH WA", "CANARY ROCKFISH", "LINGCOD", "LINGCOD", None, "NEARSHORE", None,
    ]


def test_later_rule_wins(spark):
    rules = [L.GroupRule("first", ("a", "b")), L.GroupRule("second", ("b",))]
    got = label(spark, [("a",), ("b",), ("c",)], ["s"], L.species_group_by_rules("s", F.lit("O"), rules))
    assert got == ["first", "second", "c"]
