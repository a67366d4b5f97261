"""Response rules: hand-worked rows, and properties over many values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harborline.functions import respond as R


def one(spark, column, **values):
    fields = ", ".join(
        f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items()
    )
    df = spark.createDataFrame([tuple(values.values())], fields)
    return df.select(column).collect()[0][0]


@pytest.mark.parametrize(
    "rule, t, sq, alt, threshold, expected",
    [
        (R.respond_raise, 9500.0, 7000.0, 9000.0, 0.8, 9500.0),
        (R.respond_raise, 5600.0, 7000.0, 9000.0, 0.8, 9000.0),
        (R.respond_raise, 5599.0, 7000.0, 9000.0, 0.8, 5599.0),
        (R.respond_cap, 2400.0, 2000.0, 750.0, 0.6, 750.0),
        (R.respond_cap, 700.0, 2000.0, 750.0, 0.6, 700.0),
        (R.respond_raise, 10.0, 0.0, 90.0, 0.8, 90.0),
        (R.respond_raise, 0.0, 0.0, 90.0, 0.8, None),
        (R.respond_raise, 10.0, 7.0, None, 0.8, None),
        (R.respond_raise, None, 7.0, 9.0, 0.8, None),
        (R.respond_raise, 10.0, None, 9.0, 0.8, 10.0),
        (R.respond_cap, 10.0, None, 19.0, 0.8, None),
    ],
)
def test_limits(spark, rule, t, sq, alt, threshold, expected):
    assert one(spark, rule("t", "sq", "alt", threshold), t=t, sq=sq, alt=alt) == expected


def plain(rule, t, sq, alt, threshold):
    if t >= alt:
        return t if rule == "raise" else alt
    return alt if t / sq >= threshold else t


def test_by_label_against_plain_rules(spark):
    rng = np.random.default_rng(1)
    rules = {"A": ("raise", 0.6), "B": ("cap", 0.6), "C": ("cap", 0.8)}
    pdf = pd.DataFrame(
        {
            "label": rng.choice(list("ABCD"), 2000),
            "t": rng.integers(0, 3000, 2000).astype(float),
            "sq": rng.choice([500.0, 1000.0, 2000.0], 2000),
            "alt": rng.choice([400.0, 1000.0, 2500.0], 2000),
        }
    )
    df = spark.createDataFrame(pdf)
    got = df.withColumn("r", R.respond_by_label("label", rules, "t", "sq", "alt")).toPandas()
    for row in got.itertuples():
        if row.label == "D":
            assert math.isnan(row.r)
        else:
            rule, threshold = rules[row.label]
            assert row.r == plain(rule, row.t, row.sq, row.alt, threshold)
    raised = got[got.label == "A"]
    assert (raised.r >= raised.t).all()
    capped = got[got.label.isin(["B", "C"])]
    assert (capped.r <= capped.alt).all()


def test_unknown_rule():
    with pytest.raises(ValueError):
        R.respond_by_label("x", {"A": ("lower", 0.5)}, "t", "sq", "alt")


def test_one_group_only(spark):
    raised = R.respond_raise("t", "sq", "alt", 0.9)
    column = R.for_group("g", "WIDOW", raised)
    assert one(spark, column, g="WIDOW", t=190.0, sq=200.0, alt=4000.0) == 4000.0
    assert one(spark, column, g="SHELF", t=190.0, sq=200.0, alt=4000.0) == 0.0
    assert one(spark, R.cap_at("t", "sq"), t=260.0, sq=200.0) == 200.0
    assert one(spark, R.cap_at("t", "sq"), t=60.0, sq=200.0) == 60.0


def test_in_season(spark):
    rows = [("LE", 4), ("LE", 5), ("OA", 9), ("OA", 10), ("XX", 12)]
    df = spark.createDataFrame(rows, "f string, p int")
    column = R.in_season(F.lit(5600.0), F.lit(9000.0), "f", "p", {"LE": 4, "OA": 9})
    assert [r[0] for r in df.select(column).collect()] == [5600.0, 9000.0, 5600.0, 9000.0, None]


def test_step_round(spark):
    cases = {899: 899, 900: 1000, 1450: 1000, 1899: 1000, 1900: 2000, 2500: 2000}
    df = spark.createDataFrame([(float(x),) for x in cases], "x double")
    assert [r[0] for r in df.select(R.step_round("x")).collect()] == list(cases.values())


def test_step_round_equals_half_even_form(spark):
    df = spark.range(1, 20001).select(F.col("id").cast("double").alias("x"))
    rounded = F.bround("x", -3)
    back = F.when(rounded > F.col("x") + 100, rounded - 1000).otherwise(rounded)
    other = F.when(back == 0, F.col("x")).otherwise(back)
    assert df.filter(R.step_round("x") != other).count() == 0


@pytest.mark.parametrize(
    "halibut, stepped, status_quo, alternative",
    [
        (183.0, 1000.0, 183.0, 183.0),
        (184.0, 1000.0, 230.0, 280.0),
        (400.0, 1000.0, 230.0, 280.0),
        (400.0, 899.0, 400.0, 400.0),
    ],
)
def test_ratio(spark, halibut, stepped, status_quo, alternative):
    sq, alt = R.ratio_limit("sf", 5.0), R.ratio_limit("sf", 4.0)
    assert one(spark, R.respond_ratio("h", "sf", sq, sq), h=halibut, sf=stepped) == status_quo
    assert one(spark, R.respond_ratio("h", "sf", sq, alt), h=halibut, sf=stepped) == alternative
