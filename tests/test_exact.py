"""Sums of fractions that do not depend on where rows lie."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from harborline.functions.semantics import exact_mean, exact_sum
from harborline.operators import estimate, totals
from harborline.plans import models

LAYOUTS = [1, 3, 11]


def doubles(kind):
    rng = random.Random(kind)
    if kind == "mixed":
        return [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-12, 17) for _ in range(4000)]
    if kind == "tenths":
        return [rng.randrange(1, 100_000) / 10 for _ in range(4000)]
    return [1e16, 1.0, -1e16, 3e-9, 0.1, -0.1] * 400


@pytest.mark.parametrize("kind", ["mixed", "tenths", "cancelling"])
def test_sum_is_exact_in_any_order(spark, kind):
    values = doubles(kind)
    want = sum(map(Fraction, values))
    got = set()
    for layout in LAYOUTS:
        random.Random(layout).shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(layout)
        got.add(df.agg(exact_sum("x")).first()[0])
    (value,) = got
    assert abs(Fraction(value) - want) <= max(abs(want) * Fraction(1, 2**50), Fraction(1, 2**60))


@pytest.mark.parametrize(
    ("values", "want"),
    [([], None), ([None], None), ([None, 1.5], 1.5), ([math.inf, 1.0], math.inf), ([-math.inf, 2.0], -math.inf),
     ([math.inf, -math.inf], math.nan), ([math.nan, 1.0], math.nan), ([-0.75, -0.5], -1.25), ([2.0**62, 1.0], 2.0**62)],
)
def test_odd_values(spark, values, want):
    got = spark.createDataFrame([(v,) for v in values], "x double").agg(exact_sum("x"), exact_mean("x")).first()
    assert got[0] == want or (want is not None and math.isnan(want) and math.isnan(got[0]))
    assert (got[1] is None) == (want is None)


def tickets(spark):
    rng = random.Random(9)
    rows = [
        (2001, rng.randint(1, 11), rng.randint(1, 28), f"v{rng.randrange(40)}", rng.choice("OCW"), rng.choice(["05", "06", "07"]),
         rng.choice(["1A", "1C"]), rng.choice(["SSPN_N", "SSPN_S"]), "fish", rng.randrange(1, 90_000) / 7, rng.randrange(1, 90_000) / 11)
        for _ in range(3000)
    ]
    names = """LANDING_YEAR int, LANDING_MONTH int, LANDING_DAY int, VESSEL_NUM string, AGENCY_CODE string,
        DAHL_GROUNDFISH_CODE string, PACFIN_CATCH_AREA_CODE string, ACL_CODE string,
        NOMINAL_TO_ACTUAL_PACFIN_SPECIES_NAME string, ROUND_WEIGHT_LBS double, EXVESSEL_REVENUE double"""
    return spark.createDataFrame(rows, names)


def results(df):
    """Mean price, completed months and a model, from pounds and revenue with fractions."""
    partial = estimate.partial_month(df, 2001, 11)
    months = totals.landings_tons(df, ["LANDING_MONTH"], partial=partial)
    priced = totals.with_price(totals.vessel_totals(df, ["VESSEL_NUM", "AGENCY_CODE", "LANDING_MONTH"]))
    prices = totals.mean_price(priced, ["AGENCY_CODE"])
    pop = models.pop_model(df, species=("fish",), year=2001, partial_month=11)
    return [sorted(map(tuple, x.collect()), key=str) for x in (months, prices, pop)]


def test_models_are_equal_to_the_bit(spark):
    df = tickets(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one, three, eleven = (results(df.orderBy(F.rand(n)).repartition(n)) for n in LAYOUTS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert one == three == eleven and all(one)
