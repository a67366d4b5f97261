"""Nearest neighbours: recall and scores against brute force, ties, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline.llm import neighbours as n


def frame(spark, ids, vectors):
    rows = [(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def brute(ids, vectors, k, every):
    x = vectors.astype(np.float32).astype(float)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        near = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -np.round(near, 12))) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), near[j]) for j in order]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    ids, x = np.arange(6000), rng.normal(size=(6000, 24))
    df = frame(spark, ids, x)
    got = {}
    for r in n.nearest(df, F.col("vec_id") % 50 == 0, trees=6, leaf_rows=100, leaves=60).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(ids, x, 5, 50)
    assert got.keys() == want.keys()
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5] and [-r[2] for r in rows] == sorted(-r[2] for r in rows)
        exact = dict(brute_scores(x, q))
        assert all(abs(score - exact[v]) < 1e-12 for _, v, score in rows)
        hits += len({r[1] for r in rows} & {v for v, _ in want[q]})
    assert hits / (5 * len(want)) > 0.9


def test_opened_leaves_follow_the_size(spark):
    rng = np.random.default_rng(3)
    ids, x = np.arange(6000), rng.normal(size=(6000, 16))
    rows = n.nearest(frame(spark, ids, x), F.col("vec_id") % 50 == 0, trees=6, leaf_rows=25, leaves=8).collect()
    want = {(q, v) for q, near in brute(ids, x, 5, 50).items() for v, _ in near}
    assert len({(r.query_id, r.vec_id) for r in rows} & want) / len(want) > 0.7


def brute_scores(x, q):
    x = x.astype(np.float32).astype(float)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    return list(enumerate(unit @ unit[q]))


@pytest.mark.parametrize("part_rows", [40, 5000])
def test_copies_tie_to_the_smaller_id(spark, monkeypatch, part_rows):
    monkeypatch.setattr(n, "PART_ROWS", part_rows)
    rng = np.random.default_rng(2)
    x = np.concatenate([np.tile(rng.normal(size=8), (300, 1)), rng.normal(size=(200, 8))])
    ids = rng.permutation(500)
    rows = n.nearest(frame(spark, ids, x), F.col("vec_id") % 50 == 0, leaf_rows=50, leaves=400).collect()
    want = brute(ids, x, 5, 50)
    got = {}
    for r in sorted(rows):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [v for v, _ in near] for q, near in want.items()}


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    ids = [0, 1, 2, 3, 4, 5, 6, 7, None, 50, 9, 9]
    x = [[1, 0], None, [0, 0], [nan, 1], [inf, 1], [None, 1], [], [1, 2, 3], [1, 0], [2, 0], [0, 1], [1, 1]]
    rows = n.nearest(frame(spark, ids, x), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in rows) == [
        (0, 1, 50, 1.0), (0, 2, 9, round(0.5**0.5, 6)), (50, 1, 0, 1.0), (50, 2, 9, round(0.5**0.5, 6)),
    ]
    df = frame(spark, ids, x)
    assert n.nearest(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert n.nearest(frame(spark, [50], [[1, 1]]), F.col("vec_id") % 50 == 0).collect() == []


def test_query_on_the_table(spark, sf_small):
    from harborline.llm import queries as q

    rows = q.op5_neighbours(spark, sf_small).collect()
    table = spark.read.parquet(f"{sf_small}/embeddings.parquet").toPandas()
    want = brute(table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()), 5, 50)
    got = {(r.query_id, r.vec_id) for r in rows}
    exact = {(k, v) for k, near in want.items() for v, _ in near}
    assert len(got & exact) / len(exact) > 0.9


def test_a_column_named_as_the_operators_own(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, [float(i), 1.0], i, "v") for i in range(20)], "vec_id long, embedding array<double>, __asks int, asks string")
    rows = n.nearest(df, F.col("vec_id") % 10 == 0, 3).collect()
    assert {r.query_id for r in rows} == {0, 10} and len(rows) == 6
