"""Byte shards: totals, order, slots, edge cases."""

import random
import zlib

import pytest

from harborline.llm import sharding as s


def size(text):
    return len((text or "").encode()) + 8


def check(rows, docs, shards):
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (k is not None, k or 0, size(t), zlib.crc32((t or "").encode())) for k, t in docs
    )
    total = sum(size(t) for _, t in docs)
    largest = max((size(t) for _, t in docs), default=0)
    for shard in range(shards):
        own = [r for r in rows if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / shards) <= largest
    in_order = sorted(rows, key=lambda r: (r.shard, r.slot))
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in in_order]
    assert keys == sorted(keys)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_random(spark, ranges):
    rng = random.Random(ranges)
    docs = [(rng.randrange(10**6), "é" * rng.choice([0, 5, 100, 3000])) for _ in range(500)]
    docs += [(77, "hot" * rng.randint(0, 9)) for _ in range(300)] + [(None, "x" * rng.randint(0, 50)) for _ in range(300)] + [(5, None), (5, "")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, shard int, range int")
    rows = s.shard_by_bytes(df, 7, ranges=ranges).collect()
    check(rows, docs, 7)


def test_few_and_none(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    (row,) = s.shard_by_bytes(df, 24).collect()
    assert row.size == 9 and row.slot == 0 and 0 <= row.shard < 24
    assert s.shard_by_bytes(df.limit(0), 24).collect() == []
    with pytest.raises(ValueError):
        s.shard_by_bytes(df, 0)


def test_query_and_files(spark, sf_small, tmp_path):
    from harborline.llm import queries as q

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = q.op4_sharding(spark, sf_small)
    check(rows.collect(), [(r.doc_id, r.text) for r in docs.collect()], 24)
    s.write_shards(docs, rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


@pytest.mark.parametrize("docs", [[(1, "a"), (1, "b")], [(None, "a"), (2, "b")]])
def test_keys_that_name_no_row_stop_the_files(spark, tmp_path, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    with pytest.raises(ValueError):
        s.write_shards(df, s.shard_by_bytes(df, 2), str(tmp_path / "out"))
    with pytest.raises(ValueError):
        s.write_shards(df.withColumnRenamed("text", "Shard"), df, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
