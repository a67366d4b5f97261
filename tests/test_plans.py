"""Shape of the physical plans: what must hold at any table size."""

import re

import __spark_entry__ as contract
import compare
import pytest
from plan_tree import nodes, plan_nodes
from pyspark.sql import functions as F

from harborline.operators import scope
from harborline.plans import models
from harborline.sources.tickets import read_tickets

# The optional operators for training text have their own tests.
NAMES = sorted(name for name in contract.queries() if name.startswith("q_"))
# Rows are numbered on what was written to the checkpoint folder, which shows as a scan of an RDD.
CHECKPOINTED = ("q_result_numbered", "q_result_file")
# HotSpot leaves methods beyond this many bytes uncompiled.
LARGEST_COMPILED_METHOD = 8000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_joins_and_no_python(spark, sf_small, name):
    plan = plan_of(contract.queries()[name](spark, sf_small))
    for operator in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas", "Scan ExistingRDD"):
        assert operator not in plan or (operator == "Scan ExistingRDD" and name in CHECKPOINTED)


@pytest.mark.parametrize("name", NAMES)
def test_generated_methods_are_compiled(spark, sf_small, name):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = contract.queries()[name](spark, sf_small)
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan()).iterator()
        sizes = []
        while stages.hasNext():
            sizes.append(stages.next()._3().maxMethodCodeSize())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) < LARGEST_COMPILED_METHOD


MODEL_SCANS = {
    "q_model_lingcod": [
        "GreaterThanOrEqual(l_shipdate,2000-01-01",
        "LessThan(l_shipdate,2002-01-01",
        "EqualTo(p_type,ECONOMY)",
    ],
    "q_model_pop": [
        "GreaterThanOrEqual(l_shipdate,2001-01-01", "EqualTo(p_type,ECONOMY)", "EqualTo(l_linestatus,F)",
    ],
    "q_filter_in": ["EqualTo(l_returnflag,A)", "EqualTo(l_linestatus,O)"],
    "q_model_yellowtail": ["GreaterThanOrEqual(l_shipdate,2001-01-01", "EqualTo(p_type,ECONOMY)"],
    "q_model_shelf": ["GreaterThanOrEqual(l_shipdate,2000-01-01", "In(p_name"],
    "q_model_zones": ["GreaterThanOrEqual(l_shipdate,2001-01-01", "EqualTo(p_type,ECONOMY)"],
    "q_widow_shelf": ["GreaterThanOrEqual(l_shipdate,2001-01-01", "In(p_type"],
    "q_closest_year": ["GreaterThanOrEqual(l_shipdate,1999-01-01"],
    "q_model_ratio": ["GreaterThanOrEqual(o_orderdate,2000-01-01", "In(p_type"],
}


@pytest.mark.parametrize("name", sorted(MODEL_SCANS))
def test_filters_reach_the_scan(spark, sf_small, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    df = contract.queries()[name](spark, sf_small)
    pushed = " ".join(re.findall(r"PushedFilters: \[.*?\], ReadSchema", plan_of(df).replace("\n", " ")))
    if "In(p_" in " ".join(MODEL_SCANS[name]):
        pushed = pushed.replace("Or(EqualTo(p_type", "In(p_type")
    for test in MODEL_SCANS[name]:
        assert test in pushed


def test_only_needed_columns_are_read(spark, sf_small):
    plan = plan_of(contract.queries()["q_label_fleet"](spark, sf_small))
    (schema,) = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus",
    }


@pytest.mark.parametrize(
    "name, exchanges",
    [
        ("q_period", 1),
        ("q_label_sector3", 1),
        ("q_vessel_totals", 1),
        ("q_species_overlap", 1),
        ("q_model_yellowtail", 2),
        ("q_model_shelf", 2),
        ("q_model_zones", 2),
        ("q_widow_shelf", 2),
        ("q_closest_year", 1),
        ("q_trip_pivot", 3),
    ],
)
def test_shuffles(spark, sf_small, name, exchanges):
    """With dimensions small enough to broadcast: one shuffle for the totals, one small
    one for the sums. Trips need the lines and the headers by ticket, and then the trips.
    The scalar subqueries have their own."""
    kinds = [kind for kind, _ in plan_nodes(contract.queries()[name](spark, sf_small))]
    assert kinds.count("ShuffleExchangeExec") == exchanges


@pytest.fixture
def without_broadcast(spark):
    """As if no dimension fitted a broadcast: only the bounded parameter tables do."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


LARGE = [
    "q_tickets_scan", "q_label_area", "q_species_overlap", "q_vessel_totals", "q_closest_year",
    "q_right_join_years", "q_trip_pivot", "q_model_lingcod", "q_model_pop", "q_model_shelf",
    "q_model_zones", "q_widow_shelf", "q_ns_landings", "q_model_ratio",
]


@pytest.mark.parametrize("name", LARGE)
def test_large_dimensions(spark, sf_small, without_broadcast, name):
    df = contract.queries()[name](spark, sf_small)
    found = plan_nodes(df)
    assert {"SortMergeJoinExec", "ShuffledHashJoinExec"} & {kind for kind, _ in found}
    for kind, node in found:
        if kind == "BroadcastExchangeExec":
            assert "FileSourceScanExec" not in [below for below, _ in nodes(node.child())]
    con = compare.connect(sf_small)
    assert compare.spark_result(df) == compare.oracle(con, contract.oracle_sql()[name])


def test_ticket_sums_and_header_join_share_a_shuffle(spark, sf_small, without_broadcast):
    """Lines are summed by ticket, then joined to their headers by ticket, on one shuffle
    of the lines."""
    from harborline.plans.queries import sample_trips

    plan = plan_of(sample_trips(spark, sf_small))
    assert len(re.findall(r"hashpartitioning\(l_orderkey", plan)) == 1


def test_selected_headers_filter_the_lines_before_their_shuffle(spark, sf_medium, without_broadcast):
    """A runtime filter on the tickets goes through the sums per ticket down to the scan. Only the least
    size of a scan worth filtering differs here from the session's own settings."""
    least = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    old = spark.conf.get(least)
    plain = contract.queries()["q_model_ratio"](spark, sf_medium)
    unfiltered = plain.collect()
    spark.conf.set(least, "0")
    try:
        df = contract.queries()["q_model_ratio"](spark, sf_medium)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        rows = df.collect()
    finally:
        spark.conf.set(least, old)
    scan_filter = next(x for x in plan.splitlines() if "Filter" in x and "l_quantity" in x)
    assert "might_contain" in scan_filter and "l_orderkey" in scan_filter
    assert rows == unfiltered
    assert most_shuffled(df) < most_shuffled(plain) / 5


def most_shuffled(df):
    return max(
        node.metrics().get("shuffleRecordsWritten").get().value()
        for kind, node in plan_nodes(df)
        if kind == "ShuffleExchangeExec"
    )


@pytest.mark.parametrize(
    "name", ["q_right_join_years", "q_union_fleets", "q_closest_year", "q_model_incidental"]
)
def test_lines_are_read_once(spark, sf_small, name):
    plan = plan_of(contract.queries()[name](spark, sf_small))
    assert len(re.findall(r"FileScan parquet [^\n]*l_shipdate", plan)) == 1


def test_rolling_year_reads_its_months_only(spark, tmp_path):
    """Tickets stored by year and month: 4 months of the first year and 9 of the second hold
    what either fleet wants."""
    months = [(y, m) for y in (2021, 2022, 2023) for m in range(1, 13)]
    rows = [(y, m, t, 1.0) for y, m in months for t in ("LE", "OA")]
    df = spark.createDataFrame(rows, "LANDING_YEAR int, LANDING_MONTH int, TYPE string, x double")
    df.write.partitionBy("LANDING_YEAR", "LANDING_MONTH").parquet(str(tmp_path / "by_month"))
    df.write.parquet(str(tmp_path / "plain"))
    wanted = scope.rolling_year(2022, {"LE": 8, "OA": 9})
    kept = spark.read.parquet(str(tmp_path / "by_month")).filter(wanted)
    assert kept.count() == 24 and len(kept.inputFiles()) >= 24
    assert kept.select(F.input_file_name().alias("f")).distinct().count() <= 26
    read = kept.select(F.regexp_extract(F.input_file_name(), "LANDING_YEAR=.*/", 0).alias("f"))
    assert read.distinct().count() == 13
    plan = plan_of(kept)
    assert "PartitionFilters" in plan and "LANDING_MONTH" in plan.split("PartitionFilters")[1].split("]")[0]
    pushed = plan_of(spark.read.parquet(str(tmp_path / "plain")).filter(wanted)).split("PushedFilters")[1]
    assert "GreaterThan(LANDING_MONTH,8)" in pushed and "LessThanOrEqual(LANDING_MONTH,9)" in pushed


def stored(spark, path, codes):
    rows = [
        (2001, 1 + i % 12, 1 + i % 28, f"v{i % 5}", "W", code, "1C", "fish", "GRND", 100.0 + i, None)
        for i, code in enumerate(codes * 30)
    ]
    names = """LANDING_YEAR int, LANDING_MONTH int, LANDING_DAY int, VESSEL_NUM string, AGENCY_CODE string,
        DAHL_GROUNDFISH_CODE string, PACFIN_CATCH_AREA_CODE string, NOMINAL_TO_ACTUAL_PACFIN_SPECIES_NAME string,
        MANAGEMENT_GROUP_CODE string, ROUND_WEIGHT_LBS double, EXVESSEL_REVENUE double"""
    spark.createDataFrame(rows, names).write.parquet(path)
    return path


def modelled(frame):
    pop = models.pop_model(frame, species=("fish",), year=2001)
    lingcod = models.lingcod_model(frame, species=("fish",), prior_year=2000, subarea=None)
    return pop, lingcod


def test_sector_codes_reach_the_scan_of_normalised_tickets(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    path = stored(spark, str(tmp_path / "clean"), ["05", "06", "07", "11", None])
    pop, lingcod = modelled(read_tickets(spark, path, "parquet", normalised=True))
    assert "In(DAHL_GROUNDFISH_CODE, [05,07,09])" in plan_of(pop)
    assert "In(DAHL_GROUNDFISH_CODE, [05,06,07,08,09,10])" in plan_of(lingcod)
    undeclared = modelled(read_tickets(spark, path, "parquet"))
    for one, two in zip((pop, lingcod), undeclared):
        assert "In(DAHL_GROUNDFISH_CODE" not in plan_of(two)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) != []


def test_padded_codes_count_where_not_declared(spark, tmp_path):
    clean = modelled(read_tickets(spark, stored(spark, str(tmp_path / "a"), ["05", "06", "07"]), "parquet"))
    padded = modelled(read_tickets(spark, stored(spark, str(tmp_path / "b"), [" 5", "06 ", "7"]), "parquet"))
    for one, two in zip(clean, padded):
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) != []
