"""Whole models with their own parameters against plain Python on random tickets."""

import datetime as dt
import decimal
import random

import brute
import pytest

from harborline.plans import models
from harborline.plans import parameters as P
from harborline.sources.schema import TICKET_SCHEMA

SPECIES = [
    "LINGCOD", "PACIFIC OCEAN PERCH", "YELLOWTAIL ROCKFISH", "SHORTSPINE THORNYHEAD",
    "WIDOW ROCKFISH", "BOCACCIO", "CHILIPEPPER ROCKFISH", "COWCOD", "BLUE ROCKFISH",
    "BLACK ROCKFISH", "CABEZON", "CANARY ROCKFISH", "CALIFORNIA SHEEPHEAD", "ROSY ROCKFISH",
    "SABLEFISH", None,
]
# Pounds around the limits of the species, so that every branch of the rules is met.
SCALE = {
    "LINGCOD": 6000, "PACIFIC OCEAN PERCH": 1500, "YELLOWTAIL ROCKFISH": 2500,
    "SHORTSPINE THORNYHEAD": 1500, "CALIFORNIA SHEEPHEAD": 200,
}


def make_tickets(n, seed, focus=None):
    rng = random.Random(seed)

    def maybe(value, share=0.03):
        return None if rng.random() < share else value

    rows = []
    for i in range(n):
        year, month, day = rng.randint(2019, 2024), rng.randint(1, 12), rng.randint(1, 20)
        name = rng.choice(focus or SPECIES)
        pounds = float(rng.randint(0, SCALE.get(name, 400)))
        rows.append(
            {
                "FISH_TICKET_ID": str(i),
                "LANDING_YEAR": year,
                "LANDING_MONTH": month,
                "LANDING_DAY": day,
                "LANDING_DATE": dt.date(year, month, day),
                "VESSEL_NUM": maybe(str(rng.randint(1, 6))),
                "VESSEL_REGISTRATION_ID": maybe(f"R{rng.randint(1, 6)}"),
                "AGENCY_CODE": maybe(rng.choice("COWX")),
                "DAHL_GROUNDFISH_CODE": maybe(
                    rng.choice(["05", "06", "07", "08", "09", "10", "5", "6", "7", "8", "9", "04"])
                ),
                "PACFIN_CATCH_AREA_CODE": maybe(rng.choice(["1A", "1B", "1C"])),
                "CATCH_AREA_CODE": maybe(rng.choice(["59A1", "60A2", "61"])),
                "REGION_NAME": maybe(rng.choice(["SOUTH CALIFORNIA", "OREGON"])),
                "SUBREGION_NAME": maybe(rng.choice(["SAN LUIS OBISPO", "SAN DIEGO"])),
                "ACL_CODE": maybe(rng.choice(["SSPN_N", "SSPN_S"])),
                "NOMINAL_TO_ACTUAL_PACFIN_SPECIES_NAME": name,
                "PACFIN_SPECIES_COMMON_NAME": maybe(
                    rng.choice(["PACIFIC HALIBUT", "SABLEFISH", "LINGCOD"])
                ),
                "MANAGEMENT_GROUP_CODE": maybe(rng.choice(["GRND", "GRND", "SAMN"])),
                "PARTICIPATION_GROUP_CODE": maybe(rng.choice("CCA")),
                "COUNCIL_CODE": maybe(rng.choice("PPN")),
                "GMT_SABLEFISH_CODE": maybe(rng.choice(["PRI", "LEN", "OAC"])),
                "REMOVAL_TYPE_CODE": maybe(rng.choice("CE")),
                "ROUND_WEIGHT_LBS": maybe(pounds),
                "LANDED_WEIGHT_LBS": maybe(pounds),
                "EXVESSEL_REVENUE": maybe(decimal.Decimal(rng.randint(0, 100000)).scaleb(-2)),
            }
        )
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_tickets(6000, 7)


@pytest.fixture(scope="module")
def tickets(spark, rows):
    df = spark.createDataFrame([tuple(r[f.name] for f in TICKET_SCHEMA) for r in rows], TICKET_SCHEMA)
    return df.repartition(4)


def by_key(df, n):
    return {tuple(r)[:n]: r.asDict() for r in df.collect()}


def same(df, expected, n):
    got = by_key(df, n)
    assert set(got) == set(expected) and expected
    for key, values in expected.items():
        for name, value in values.items():
            assert got[key][name] == pytest.approx(value, rel=1e-9), (key, name)
    return got


def test_lingcod(tickets, rows):
    expected = brute.lingcod(rows)
    plain = {k: {c: v for c, v in vs.items() if not c.startswith("INS")} for k, vs in expected.items()}
    got = same(models.lingcod_model(tickets), plain, 1)
    for row in got.values():
        assert row["ALT2_YEYE_MT"] == pytest.approx(row["A2_MT"] * 0.008882069)
        assert row["Extra_YEYE_ALT3"] == pytest.approx((row["A3_MT"] - row["SQ_MT"]) * 0.008882069)
        assert row["SQ_MT"] <= row["A1_MT"] <= row["A2_MT"] <= row["A3_MT"]
    seasonal = by_key(models.lingcod_model(tickets, in_season=True), 1)
    for key, values in expected.items():
        for name, value in values.items():
            column = name if name.startswith("INS") else f"P_{name}"
            assert seasonal[key][column] == pytest.approx(value, rel=1e-9)


def test_lingcod_sectors_add_up(tickets):
    by_fleet = by_key(models.lingcod_model(tickets), 1)
    by_sector = models.lingcod_model(tickets, by=("TYPE", "SECTOR")).collect()
    for (kind,), row in by_fleet.items():
        assert sum(r.A1_MT for r in by_sector if r.TYPE == kind) == pytest.approx(row["A1_MT"])


def test_pop(tickets, rows):
    same(models.pop_model(tickets), brute.pop(rows), 2)


def test_yellowtail(tickets, rows):
    same(models.yellowtail_model(tickets), brute.yellowtail(rows), 2)


def test_shelf(tickets, rows):
    same(models.shelf_model(tickets), brute.shelf(rows, P.SHELF_SPECIES), 1)
    whole = models.shelf_model(tickets, last_month=None, area=None)
    same(whole, brute.shelf(rows, P.SHELF_SPECIES, None, None), 1)


def test_widow_shelf(tickets, rows):
    same(models.widow_shelf_model(tickets), brute.widow_shelf(rows), 3)


def test_widow_and_shelf_add_up_before_limits(tickets):
    landed = models.widow_shelf_totals(tickets).groupBy("SPPGROUP").sum("tlbs")
    sums = dict(landed.collect())
    assert sums["WIDOW"] + sums["SHELF"] == pytest.approx(sums["WIDOW&SHELF"])


@pytest.mark.parametrize("monthly", [False, True])
def test_zones(tickets, rows, monthly):
    got = same(models.zones_model(tickets, monthly_totals=monthly), brute.zones(rows, monthly), 1)
    assert got["LESS",]["A2_MT"] is None and got["OAN",]["A3_MT"] is None


def test_zones_with_monthly_limits(tickets):
    got = by_key(models.zones_model(tickets, P.ZONE_LIMITS_MONTHLY_OA), 1)
    same_zones = by_key(models.zones_model(tickets), 1)
    assert got["LEN",] == same_zones["LEN",]
    assert got["OAN",]["SQ_MT"] == pytest.approx(same_zones["OAN",]["SQ_MT"])
    assert got["OAN",]["A1_MT"] != same_zones["OAN",]["A1_MT"]


def test_any_zones_with_limits_count(tickets):
    limits = lambda *zones: [P.LimitSchedule(z, "two_month", {"SQ": 100, "A1": 50}) for z in zones]
    rules = {"A1": {z: ("cap", 0.8) for z in models.zone_tests()}}
    every = by_key(models.zones_model(tickets, limits(*models.zone_tests()), rules), 1)
    some = by_key(models.zones_model(tickets, limits("LES", "OASS"), rules), 1)
    assert {z for (z,) in every} == set(models.zone_tests())
    assert some == {k: v for k, v in every.items() if k[0] in ("LES", "OASS")}
    with pytest.raises(ValueError, match="OAX"):
        models.zones_model(tickets, limits("LES", "OAX"), rules)


def test_nearshore(tickets, rows):
    def label(name, agency):
        if agency == "W" and name == "CANARY ROCKFISH":
            return "CANARY ROCKFISH WA"
        if agency == "O" and name in ("CABEZON", "KELP GREENLING"):
            return "CABEZON/KELP GREENLING"
        if agency == "O" and name in ("BLACK ROCKFISH", "BLUE ROCKFISH"):
            return "BLACK/BLUE/DEACON ROCKFISH"
        return "NEARSHORE" if name == "BLUE ROCKFISH" else name

    expected = {
        k: {"P_SQMT": v[0], "P_EXVESSEL": v[1]}
        for k, v in brute.nearshore(rows, P.NEARSHORE_SPECIES, label).items()
    }
    same(models.nearshore_landings(tickets), expected, 5)


def test_closest_year(tickets, rows):
    got = by_key(models.closest_year_model(tickets, (2021, 2022, 2023)), 2)
    expected = brute.closest_year(rows, (2021, 2022, 2023))
    assert set(got) == set(expected)
    for key, (now, estimate) in expected.items():
        assert got[key]["MT_z"] == pytest.approx(now)
        want = estimate if estimate is None else pytest.approx(estimate)
        assert got[key]["ESTIMATED_MT"] == want


def test_incidental(spark):
    rows = [
        {**r, "LANDED_WEIGHT_LBS": None if r["LANDED_WEIGHT_LBS"] is None else w}
        for r, w in zip(
            make_tickets(9000, 11), (float(random.Random(i).randint(0, 1500)) for i in range(9000))
        )
    ]
    for r in rows:  # few days and vessels, so that trips hold both species
        r["LANDING_DATE"] = r["LANDING_DATE"].replace(day=1 + r["LANDING_DAY"] % 2)
        r["AGENCY_CODE"] = "W" if r["FISH_TICKET_ID"][-1] < "8" else "O"
        if r["PACFIN_SPECIES_COMMON_NAME"] == "PACIFIC HALIBUT" and r["LANDED_WEIGHT_LBS"]:
            r["LANDED_WEIGHT_LBS"] = float(int(r["LANDED_WEIGHT_LBS"]) // 3)
    df = spark.createDataFrame([tuple(r[f.name] for f in TICKET_SCHEMA) for r in rows], TICKET_SCHEMA)
    got = models.incidental_projection(df).collect()[0]
    expected = brute.incidental(rows)
    assert expected[1] != expected[2]
    assert tuple(got)[1:] == pytest.approx(expected)


def test_no_landings_give_no_rows(spark):
    empty = spark.createDataFrame([], TICKET_SCHEMA)
    for name in ("lingcod", "pop", "yellowtail", "shelf", "widow_shelf", "zones", "nearshore"):
        assert models.MODELS[name](empty).count() == 0


@pytest.mark.parametrize("name", [*models.MODELS, "lingcod in season", "zones by month"])
def test_same_result_on_any_partitioning(tickets, name):
    """Not only close: whole pounds sum to the same number in any order, and those of a
    partial month are scaled after the sum."""
    run, options = models.MODELS[name.split()[0]], {}
    if name == "closest_year":
        options = {"years": (2019, 2022, 2023)}
    elif name == "lingcod in season":
        options = {"in_season": True}
    elif name == "zones by month":
        options = {"monthly_totals": True}
    results = [sorted(run(tickets.repartition(n), **options).collect(), key=str) for n in (1, 3, 11)]
    if name == "widow_shelf":  # sums of completed months of many vessels, which are no whole pounds
        results = [
            [tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in r] for r in results
        ]
    assert results[0] == results[1] == results[2]


def test_results_do_not_depend_on_ansi_mode(spark, tickets):
    strict = sorted(models.yellowtail_model(tickets).collect())
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert sorted(models.yellowtail_model(tickets).collect()) == strict
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
