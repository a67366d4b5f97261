"""Missing values and arithmetic."""

import math

from pyspark.sql import functions as F

from harborline.functions import semantics as S


def values(df, *exprs):
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_conditional_on_a_missing_value_is_missing(spark):
    df = spark.createDataFrame([("05",), ("08",), (None,)], "c string")
    want = [("LE",), ("OA",), (None,)]
    assert values(df, S.if_known(F.col("c") == "05", F.lit("LE"), F.lit("OA"))) == want
    assert values(df, S.if_known(F.col("c") == "05", "LE", "OA", ["c"])) == want


def test_division_by_zero(spark):
    rows = [(0.0, 0.0), (5.0, 0.0), (6.0, 2.0), (-1.0, 0.0), (None, 0.0), (1.0, None)]
    df = spark.createDataFrame(rows, "n double, d double")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        got = [v for (v,) in values(df, S.divide("n", "d"))]
        assert math.isnan(got[0])
        assert got[1:] == [math.inf, 3.0, -math.inf, None, None]
    spark.conf.set("spark.sql.ansi.enabled", "true")


def test_division_takes_decimals(spark):
    df = spark.createDataFrame([(6, 4)], "n int, d int").select(
        F.col("n").cast("decimal(18,2)").alias("n"), "d"
    )
    assert values(df, S.divide("n", "d")) == [(1.5,)]


def test_nan_never_wins_a_comparison(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,), (None,)], "x double")
    assert values(df, S.nan_to_null("x") > 1) == [(None,), (True,), (None,)]


def test_group_without_known_values_sums_to_zero(spark):
    df = spark.createDataFrame(
        [("a", None), ("a", None), ("b", 2.0), ("b", float("nan"))], "k string, x double"
    )
    got = dict(df.groupBy("k").agg(S.sum_known(S.known(df, "x"))).collect())
    assert got == {"a": 0.0, "b": 2.0}


def test_complete_cases_drop_null_and_nan(spark):
    df = spark.createDataFrame(
        [("a", 1.0), (None, 1.0), ("b", None), ("c", float("nan")), ("d", math.inf)],
        "k string, x double",
    )
    assert [r.k for r in S.complete_cases(df).collect()] == ["a", "d"]
    assert [r.k for r in S.complete_cases(df, ["k"]).collect()] == ["a", "b", "c", "d"]


def test_filling_touches_numbers_only(spark):
    df = spark.createDataFrame(
        [(None, None, None), ("a", float("nan"), 1)], "k string, x double, n int"
    )
    assert values(S.fill_missing(df), "*") == [(None, 0.0, 0), ("a", 0.0, 1)]


def test_lookup(spark):
    df = spark.createDataFrame([("a",), ("it's",), ("z",), (None,)], "k string")
    assert values(df, S.lookup({"a": 1, "it's": 2}, "k")) == [(1,), (2,), (None,), (None,)]
