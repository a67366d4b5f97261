"""Trip tables stored by ticket: same results, and no line moves."""

import __spark_entry__ as contract
import compare
import pytest
from plan_tree import nodes, plan_nodes
from pyspark.sql import functions as F
from test_skew import skewed  # noqa: F401

from harborline.sources import stored

NAMES = sorted(n for n in contract.queries() if n.startswith("q_stored_"))


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    """Headers of any size: no join is a broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", NAMES)
def test_lines_and_headers_meet_where_they_lie(spark, sf_small, name):
    df = contract.queries()[name](spark, sf_small)
    joins = [plan for kind, plan in plan_nodes(df) if kind == "SortMergeJoinExec"]
    assert len(joins) == 1
    below = [kind for kind, _ in nodes(joins[0])]
    assert below.count("FileSourceScanExec") == 2 and "ShuffleExchangeExec" not in below
    assert compare.spark_result(df) == compare.oracle(compare.connect(sf_small), contract.oracle_sql()[name])


@pytest.mark.parametrize("name", ["q_stored_month_profile", "q_stored_model_ratio"])
def test_a_hot_ticket(spark, skewed, name):  # noqa: F811
    df = contract.queries()[name](spark, skewed)
    assert compare.spark_result(df) == compare.oracle(compare.connect(skewed), contract.oracle_sql()[name])


def test_a_hot_ticket_is_summed_on_the_way(spark, tmp_path):
    rows = [(1 if i % 3 == 0 else i, "ab"[i % 2], None if i % 5 == 0 else float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "ticket long, species string, lbs double").repartition(4)
    table = stored.store_by_ticket(df, "hot_lines", "ticket", 4, {"lbs": F.sum("lbs")}, ["species"])
    assert table.where("ticket = 1").count() == 2
    assert table.agg(F.sum("lbs")).first()[0] == sum(r[2] or 0 for r in rows)
    assert stored.stored(spark, "hot_lines").count() == table.count() and stored.stored(spark, "none_such") is None
    plain = stored.store_by_ticket(df, "plain_lines", "ticket", 4)
    assert sorted(map(str, plain.collect())) == sorted(map(str, df.collect()))


def test_numbers_of_buckets():
    assert [stored.buckets_for(n) for n in (0, 1, 4_000_000, 4_000_001, 10**12)] == [1, 1, 1, 2, 262144]
    assert stored.buckets_for(5, at_least=12) == 16
