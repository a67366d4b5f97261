"""Readers and the result writer."""

import datetime as dt
import decimal
import glob

import pytest
from pyspark.errors import NumberFormatException
from pyspark.sql import functions as F

from harborline.__main__ import run
from harborline.operators import tables
from harborline.sources.schema import conform
from harborline.sources import schema, tickets
from harborline.sources.results import as_text, write_result

CSV = """\
VESSEL_NUM,PACFIN_YEAR,LANDING_MONTH,DAHL_GROUNDFISH_CODE,AGENCY_CODE,ROUND_WEIGHT_LBS (SUM),EXVESSEL_REVENUE,PORT_NAME
 101 ,2019,3,05,O,1500.5,20.10,ASTORIA
102,2019, 4 ,7,NA,NA,NA,
NA,2019,5,10,C,,1e2,NEAH BAY
,2019,6,08,W,7,3,"A, B"
"""


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv(spark, tmp_path):
    df = tickets.read_tickets(spark, write(tmp_path / "t.csv", "﻿" + CSV))
    assert dict(df.dtypes)["ROUND_WEIGHT_LBS"] == "double"
    assert dict(df.dtypes)["EXVESSEL_REVENUE"] == "decimal(24,6)"
    got = [r.asDict() for r in df.collect()]
    assert [r["VESSEL_NUM"] for r in got] == ["101", "102", None, ""]
    assert [r["LANDING_YEAR"] for r in got] == [2019] * 4
    assert [r["LANDING_MONTH"] for r in got] == [3, 4, 5, 6]
    assert [r["DAHL_GROUNDFISH_CODE"] for r in got] == ["05", "07", "10", "08"]
    assert [r["AGENCY_CODE"] for r in got] == ["O", None, "C", "W"]
    assert [r["ROUND_WEIGHT_LBS"] for r in got] == [1500.5, None, None, 7.0]
    assert got[0]["EXVESSEL_REVENUE"] == decimal.Decimal("20.10")
    assert [r["PORT_NAME"] for r in got] == ["ASTORIA", "", "NEAH BAY", "A, B"]


def test_csv_columns_and_order(spark, tmp_path):
    path = write(tmp_path / "t.csv", "LANDING_MONTH,VESSEL_NUM\n2,a\n")
    df = tickets.read_tickets(spark, path, columns=["VESSEL_NUM", "LANDING_MONTH"])
    assert [r.asDict() for r in df.collect()] == [{"LANDING_MONTH": 2, "VESSEL_NUM": "a"}]
    with pytest.raises(ValueError):
        tickets.read_tickets(spark, path, columns=["AGENCY_CODE"])


def test_csv_dates(spark, tmp_path):
    path = write(tmp_path / "t.csv", "LANDING_DATE\n4/12/2019\nNA\n")
    df = tickets.read_tickets(spark, path, date_format="M/d/yyyy")
    assert [r[0] for r in df.collect()] == [dt.date(2019, 4, 12), None]


def test_text_in_a_number_column_stops(spark, tmp_path):
    path = write(tmp_path / "t.csv", "LANDING_MONTH\nMay\n")
    with pytest.raises(NumberFormatException):
        tickets.read_tickets(spark, path).collect()


@pytest.mark.parametrize("record", ["x,2022,3,4.0,5", "x,2022", "x"])
def test_records_that_do_not_fit_the_header_stop(spark, tmp_path, record):
    path = write(tmp_path / "odd.csv", f"VESSEL_NUM,LANDING_YEAR,ROUND_WEIGHT_LBS\n{record}\n")
    for df in (tickets.read_tickets(spark, path), tickets.read_tickets(spark, path).select("VESSEL_NUM")):
        with pytest.raises(Exception, match="odd.csv"):
            df.collect()


def test_revenue_keeps_its_digits_or_stops(spark, tmp_path):
    path = write(tmp_path / "m.csv", "VESSEL_NUM,EXVESSEL_REVENUE\na,1.005\nb,0.004\nc,NA\nd,12\n")
    got = {r[0]: r[1] for r in tickets.read_tickets(spark, path, columns=["VESSEL_NUM", "EXVESSEL_REVENUE"]).collect()}
    assert {k: None if v is None else float(v) for k, v in got.items()} == {"a": 1.005, "b": 0.004, "c": None, "d": 12.0}
    path = write(tmp_path / "n.csv", "VESSEL_NUM,EXVESSEL_REVENUE\na,1.0000005\n")
    with pytest.raises(Exception, match="decimals"):
        tickets.read_tickets(spark, path).collect()
    doubles = spark.createDataFrame([(0.1 + 0.2,), (1e9 + 0.25,)], "EXVESSEL_REVENUE double")
    assert [float(r[0]) for r in conform(doubles).collect()] == [0.3, 1e9 + 0.25]


def test_header_names(spark):
    df = spark.createDataFrame([(1, 2)], "`PACFIN_YEAR` int, `LANDING_YEAR` int")
    assert schema.normalise_headers(df).columns == ["PACFIN_YEAR", "LANDING_YEAR"]
    with pytest.raises(ValueError):
        schema.normalise_headers(spark.createDataFrame([(1, 2)], "`A b` int, `a_b` int"))


def test_parquet_by_year_is_pruned(spark, tmp_path):
    rows = [(y, m, f"{y}{m}", 1.0) for y in (2019, 2020) for m in (1, 2)]
    df = spark.createDataFrame(
        rows, "LANDING_YEAR int, LANDING_MONTH int, VESSEL_NUM string, ROUND_WEIGHT_LBS double"
    )
    path = str(tmp_path / "tickets")
    df.write.partitionBy("LANDING_YEAR").parquet(path)
    read = tickets.read_tickets(spark, path, "parquet").filter("LANDING_YEAR = 2020")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(LANDING_YEAR" in plan
    assert read.count() == 2


def test_database_predicates(spark):
    predicates = tickets.month_predicates([2022, 2023])
    assert len(predicates) == 24
    assert predicates[0] == "LANDING_YEAR = 2022 AND LANDING_MONTH = 1"
    with pytest.raises(ValueError):
        tickets.read_tickets_jdbc(spark, "jdbc:none", "t", [])


def read_csv(path):
    text = [open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*"))]
    return [line for t in text for line in t.splitlines()]


def fixed(value):
    return f"{value:.12f}".rstrip("0")


def test_result_in_fixed_notation(spark, tmp_path):
    values = [1.0e7, 123456789.5, 0.1, -2.0, 0.0, 1e-4, None, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([("k", v) for v in values], "k string, x double")
    assert [r.x for r in as_text(df).collect()] == [
        "10000000", "123456789.5", "0.1", "-2", "0", "0.0001", None, "NaN", "Inf", "-Inf",
    ]
    path = str(tmp_path / "out")
    write_result(df.coalesce(1), path)
    assert read_csv(path)[:2] == ["k,x", "k,10000000"]
    assert "k,NA" in read_csv(path)


def test_run_from_csv_to_csv(spark, tmp_path):
    head = (
        "VESSEL_NUM,PACFIN_YEAR,LANDING_MONTH,LANDING_DAY,AGENCY_CODE,DAHL_GROUNDFISH_CODE,"
        "PACFIN_CATCH_AREA_CODE,NOMINAL_TO_ACTUAL_PACFIN_SPECIES_NAME,ROUND_WEIGHT_LBS,EXVESSEL_REVENUE\n"
    )
    lines = [
        "1,2019,1,5,O,05,1A,PACIFIC OCEAN PERCH,1700,10",
        "1,2019,12,31,O,05,1A,PACIFIC OCEAN PERCH,100,10",
        "2,2019,1,5,O,06,1A,PACIFIC OCEAN PERCH,1700,10",
    ]
    path = write(tmp_path / "t.csv", head + "\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    run(spark, "pop", path, out)
    assert read_csv(out) == [
        "LANDING_YEAR,TYPE,P_SQMT,P_A1_MT",
        f"2019,LE,{fixed(1800 / 2204.6)},{fixed(3700 / 2204.6)}",
    ]


def test_command_line(spark, tmp_path, monkeypatch):
    from harborline import __main__ as command

    text = (
        "VESSEL_NUM,LANDING_YEAR,LANDING_MONTH,AGENCY_CODE,DAHL_GROUNDFISH_CODE,PACFIN_CATCH_AREA_CODE,"
        "NOMINAL_TO_ACTUAL_PACFIN_SPECIES_NAME,ROUND_WEIGHT_LBS,EXVESSEL_REVENUE\n"
        "1,2020,1,W,6,1A,YELLOWTAIL ROCKFISH,1100,10\n1,2020,7,W,6,1A,YELLOWTAIL ROCKFISH,1100,10\n"
    )
    out = str(tmp_path / "out")
    argv = ["harborline", "yellowtail", "--tickets", write(tmp_path / "t.csv", text), "--out", out]
    argv += ["--set", "year=2020", "--set", "before_month=3"]
    monkeypatch.setattr("sys.argv", argv)
    command.main()
    expected = [
        "LANDING_MONTH,TYPE,P_SQMT,P_A1_MT",
        f"1,OA,{fixed(1100 / 2204.6)},{fixed(2500 / 2204.6)}",
    ]
    assert read_csv(out) == expected
    assert command._setting("area=N4010") == ("area", "N4010")


HEADER = ["VESSEL_NUM", "LANDING_YEAR", "AGENCY_CODE"]


def records(spark, *lines):
    return spark.createDataFrame([(line,) for line in lines], "value string")


def test_records_in_a_column(spark):
    lines = records(spark, '"a, ""b""",2019,NA', r'"c\",2020,""', " d , 2021 , W ", ",,")
    typed = tickets.conform_text(tickets.parse_lines(lines, HEADER)).select(*HEADER)
    assert [tuple(r) for r in typed.collect()] == [('a, "b"', 2019, None), ("c\\", 2020, ""), ("d", 2021, "W"), ("", None, "")]


@pytest.mark.parametrize("record", ["x,2022", "x,2022,O,more", "x"])
def test_records_that_do_not_fit_stop_or_come_out(spark, record):
    lines = records(spark, "a,2019,O", record)
    for df in (tickets.parse_lines(lines, HEADER), tickets.parse_lines(lines, HEADER).select("VESSEL_NUM")):
        with pytest.raises(Exception, match="MALFORMED"):
            df.collect()
    got = tickets.parse_lines(lines, HEADER, malformed="RECORD")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", "2019", "O", None), (None, None, None, record)], key=str)
    assert got.select("VESSEL_NUM", "RECORD").where("RECORD is not null").collect()[0] == (None, record)
    assert sorted(r[0] or "" for r in got.select("VESSEL_NUM").collect()) == ["", "a"]


def test_quotes_in_files(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'VESSEL_NUM,PORT_NAME\na,"say ""hi"", now"\n"b\\",c\n')
    got = [tuple(r) for r in tickets.read_tickets(spark, path).select("VESSEL_NUM", "PORT_NAME").collect()]
    assert got == [("a", 'say "hi", now'), ("b\\", "c")]


def test_appended_subsets(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (3, "y")], "n int, s string")
    subsets = [
        tables.Subset(F.col("n") > 1, {"n": "n", "twice": F.col("n") * 2}),
        tables.Subset(F.col("s") == "y", {"s": "s", "n": "n"}),
    ]
    one = tables.append_subsets(df, subsets)
    two = tables.append(*(df.where(x.test).select(*(tables._column(c).alias(n) for n, c in x.columns.items())) for x in subsets))
    assert one.columns == two.columns == ["n", "twice", "s"]
    rows = sorted(map(tuple, one.collect()), key=str)
    assert rows == sorted(map(tuple, two.collect()), key=str) and len(rows) == 5
    with pytest.raises(ValueError):
        tables.append_subsets(df, [tables.Subset(F.lit(True), {"a": "n"}), tables.Subset(F.lit(True), {"a": "s"})])


@pytest.mark.parametrize("name", ["q_union_fleets", "q_append_unlike"])
def test_appends_scan_the_lines_once(spark, sf_small, name):
    import __spark_entry__ as contract

    plan = contract.queries()[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem") == 1 and "Union" not in plan
