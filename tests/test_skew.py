"""A third of all rows on one vessel, one species and one ticket."""

import datetime as dt
import shutil
from collections import Counter

import __spark_entry__ as contract
import compare
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from plan_tree import plan_nodes
from pyspark.sql.functions import spark_partition_id

from harborline.operators.joins import right_join

N = 60_000


@pytest.fixture(scope="module")
def skewed(sf_small, tmp_path_factory):
    """The sample tables with line items of which a third share every key."""
    folder = tmp_path_factory.mktemp("skewed")
    for name in compare.TABLES:
        if name != "lineitem":
            shutil.copy(f"{sf_small}/{name}.parquet", folder)
    old = pq.read_table(f"{sf_small}/lineitem.parquet")
    pdf = old.to_pandas()
    base = pdf.sample(N, replace=True, random_state=3).reset_index(drop=True)
    part = pq.read_table(f"{sf_small}/part.parquet").to_pandas()
    hot = np.arange(N) < N // 3
    base.loc[hot, "l_orderkey"] = base["l_orderkey"].iloc[0]
    base.loc[hot, "l_suppkey"] = 1
    base.loc[hot, "l_partkey"] = int(part[part.p_type == "ECONOMY"].p_partkey.iloc[0])
    base.loc[hot, "l_shipdate"] = pd.Timestamp(dt.datetime(2001, 3, 4))
    base = base.sample(frac=1, random_state=4)
    pq.write_table(
        pa.Table.from_pandas(base, schema=old.schema, preserve_index=False),
        folder / "lineitem.parquet",
        row_group_size=8_000,
    )
    return str(folder)


@pytest.fixture(params=["broadcast", "shuffle"])
def joins(request, spark):
    """Both join strategies; for the shuffle join, sizes scaled down so that the hot
    partitions count as skewed."""
    changes = {
        "spark.sql.files.maxPartitionBytes": "64k",
        "spark.sql.files.openCostInBytes": "1k",
    }
    if request.param == "shuffle":
        changes |= {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "16",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        }
    old = {key: spark.conf.get(key) for key in changes}
    for key, value in changes.items():
        spark.conf.set(key, value)
    yield request.param
    for key, value in old.items():
        spark.conf.set(key, value)


QUERIES = [
    "q_vessel_totals", "q_species_overlap", "q_label_area", "q_respond_raise", "q_trip_pivot",
    "q_model_lingcod", "q_model_pop", "q_widow_shelf", "q_model_zones", "q_ns_landings",
]


@pytest.mark.parametrize("name", QUERIES)
def test_results_hold(spark, skewed, joins, name):
    df = contract.queries()[name](spark, skewed)
    assert compare.spark_result(df) == compare.oracle(
        compare.connect(skewed), contract.oracle_sql()[name]
    )


@pytest.mark.parametrize("joins", ["shuffle"], indirect=True)
def test_hot_partition_of_a_join_is_split(spark, skewed, joins):
    df = contract.queries()["q_label_area"](spark, skewed)
    df.collect()
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def shuffled_records(df):
    return sum(
        node.metrics().get("shuffleRecordsWritten").get().value()
        for kind, node in plan_nodes(df)
        if kind == "ShuffleExchangeExec"
    )


@pytest.mark.parametrize("joins", ["broadcast"], indirect=True)
@pytest.mark.parametrize("name", ["q_species_overlap", "q_respond_raise"])
def test_hot_groups_shrink_before_the_shuffle(spark, skewed, joins, name):
    """Sums run in two stages, so a group with a third of all rows leaves each task as one."""
    df = contract.queries()[name](spark, skewed)
    df.collect()
    assert 0 < shuffled_records(df) < N / 6


@pytest.mark.parametrize("joins", ["broadcast", "shuffle"], indirect=True)
def test_missing_keys_are_dealt_over_buckets(spark, joins):
    """A third of the rows lack one key, some of them both."""
    rows = [(None if i % 3 == 0 else i % 50, None if i % 30 == 0 else f"s{i % 4}", i) for i in range(N)]
    right = spark.createDataFrame(rows, "k int, s string, i int").repartition(9)
    left = spark.createDataFrame(
        [(k, s, f"{k}{s}") for k in [*range(40), None] for s in ("s0", "s1", None)], "k int, s string, x string"
    )
    names = {(r.k, r.s): r.x for r in left.collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = right_join(left, right, ["k", "s"])
        got = joined.withColumn("part", spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted((r.i, r.x) for r in got) == [(i, names.get((k, s))) for k, s, i in rows]
    largest = max(Counter(r.part for r in got).values())
    assert joins == "broadcast" or largest < N / 6
