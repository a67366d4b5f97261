"""Sorted and numbered rows over many partitions."""

import glob
import random

import pytest
from plan_tree import plan_nodes
from pyspark.sql import functions as F

from harborline import session
from harborline.operators import order
from harborline.sources.results import read_result, write_result

N = 6000


@pytest.fixture(params=[True, False])
def ranges(request, spark):
    """Many small partitions, merged by adaptive execution or not."""
    changes = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": str(request.param).lower()}
    old = {k: spark.conf.get(k) for k in changes}
    for k, v in changes.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def frame(spark, partitions=7):
    """A third of the rows share every key, a tenth have none."""
    rng = random.Random(1)
    rows = []
    for i in range(N):
        key = "hot" if i % 3 == 0 else None if i % 10 == 1 else rng.choice("abcdefgh")
        rows.append((key, 0 if i % 3 == 0 else rng.randrange(50), i))
    return rows, spark.createDataFrame(rows, "k string, row int, came int").repartition(partitions, "came")


def place(row):
    return row[0] is None, row[0] or "", row[1]


def test_numbers(spark, ranges):
    rows, df = frame(spark)
    got = sorted(order.row_numbered(df, ["k", "row"]).collect(), key=lambda r: r.ROW)
    assert [r.ROW for r in got] == list(range(1, N + 1))
    assert [place(r) for r in got] == sorted(place(r) for r in rows)
    assert sorted(r.came for r in got) == list(range(N))
    assert order.row_numbered(df.limit(0), ["k"]).collect() == []


def test_without_keys_rows_keep_their_order(spark, ranges):
    df = spark.range(0, N, 1, 5)
    got = order.row_numbered(df, [], "AT").collect()
    assert all(r.AT == r.id + 1 for r in got) and len(got) == N


def test_a_hot_key_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        _, df = frame(spark)
        sizes = order.in_order(df, ["k", "row"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) == 12 and max(r["count"] for r in sizes) < N / 6


def test_sums_before(spark):
    rng = random.Random(2)
    counts = {k: rng.randrange(100) for k in range(0, 90) if k % 7}
    df = spark.createDataFrame(sorted(counts.items()), "part long, n long").repartition(3)
    got = {r.part: r.before for r in order.sums_before(df, "part", "n", block=4).collect()}
    assert got == {k: sum(n for j, n in counts.items() if j < k) for k in counts}


def test_no_window_sees_all_rows(spark):
    _, df = frame(spark)
    windows = [plan for kind, plan in plan_nodes(order.row_numbered(df, ["k"])) if kind == "WindowExec"]
    assert windows and all(not w.partitionSpec().isEmpty() for w in windows)


def test_files_hold_the_rows_in_order(spark, ranges, tmp_path):
    rows, df = frame(spark)
    path = str(tmp_path / "sorted")
    write_result(df, path, order=["k", "row"])
    assert len(glob.glob(f"{path}/part-*")) > 1 or spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = sorted(read_result(spark, path, df.schema).collect(), key=lambda r: r.PLACE)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.PLACE for r in got] == list(range(1, N + 1))
    assert [place(r) for r in got] == sorted(place(r) for r in rows)


def test_row_names_in_files(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.5), (None, 2.0), ("a", None)], "k string, x double").repartition(2)
    path = str(tmp_path / "named")
    write_result(df, path, order=["k"], row_names=True)
    lines = [line for f in sorted(glob.glob(f"{path}/part-*")) for line in open(f).read().splitlines()]
    assert set(lines) == {",k,x", "1,a,NA", "2,b,1.5", "3,NA,2"}
    back = read_result(spark, path, df.schema, row_names=True).collect()
    assert sorted(tuple(r) for r in back) == [(1, "a", None, 1), (2, "b", 1.5, 2), (3, None, 2.0, 3)]


def test_the_shared_folder_is_no_temporary_one_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.shared_folder(Session())
