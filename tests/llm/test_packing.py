"""Packing against a plain search for the tightest bin."""

import random
from collections import Counter, defaultdict

import pytest

from harborline.llm import packing as p


def brute(sizes, sources, clusters, capacity, repeats):
    """The same rule by looking at every bin."""
    bins, out = [], []
    for row in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        begin = 0
        while sizes[row] - begin > 0:
            words = min(capacity, sizes[row] - begin)
            fit = [
                (capacity - b["n"], i) for i, b in enumerate(bins)
                if b["n"] + words <= capacity
                and (sources[row] is None or b["s"][sources[row]] < repeats)
                and (clusters[row] is None or not b["c"][clusters[row]])
            ]
            if fit:
                number = min(fit)[1]
            else:
                number = len(bins)
                bins.append({"n": 0, "s": Counter(), "c": Counter()})
            b = bins[number]
            out.append((row, begin, words, number, b["n"]))
            b["n"] += words
            b["s"][sources[row]] += 1
            b["c"][clusters[row]] += 1
            begin += words
    return out


@pytest.mark.parametrize("repeats", [1, 2, 3])
def test_the_tightest_compatible_bin(repeats):
    rng = random.Random(repeats)
    for _ in range(30):
        n = rng.randint(0, 120)
        sizes = [rng.choice([0, rng.randint(1, 30), rng.randint(1, 250)]) for _ in range(n)]
        sources = [rng.choice(["a", "a", "b", "c", None]) for _ in range(n)]
        clusters = [rng.choice([None, 1, 2, 3, *range(10, 60)]) for _ in range(n)]
        assert p.pack_block(sizes, sources, clusters, 100, repeats) == brute(sizes, sources, clusters, 100, repeats)


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_dataframe(spark, block_rows):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices("abcde", k=rng.choice([0, 3, 20, 45, 260]))), rng.choice(["s", "s", "t", None]), i) for i in range(150)]
    docs += [(None, "same text here", "s", 1)] * 40 + [(7, "same Text  here", "t", 1)] * 3 + [(600, None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, bin int")
    rows = p.pack(df, capacity=50, block_rows=block_rows).collect()
    words = Counter()
    for key, text, *_ in docs:
        words[key] += len((text or "").split())
    got = Counter()
    bins = defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.words
        if r.bin is not None:
            bins[r.bin].append((r.place, r.words, r.doc_id))
    assert got == words and sum(r.bin is None for r in rows) == sum(not (d[1] or "").strip() for d in docs)
    for parts in bins.values():
        parts.sort()
        assert [x[0] for x in parts] == [sum(y[1] for y in parts[:i]) for i in range(len(parts))]
        assert sum(x[1] for x in parts) <= 50
        assert sum(x[2] in (None, 7) and x[1] == 3 for x in parts) <= 1  # one of the cluster
    assert p.pack(df.limit(0)).collect() == []


def test_given_clusters(spark):
    df = spark.createDataFrame([(i, f"w{i}", "s", i // 5) for i in range(20)], "doc_id long, text string, source string, c long")
    rows = p.pack(df, source_repeats=20, cluster="c").collect()
    per_bin = Counter((r.bin, r.doc_id // 5) for r in rows)
    assert max(per_bin.values()) == 1 and len({r.bin for r in rows}) == 5


def test_query_on_the_table(spark, sf_small):
    from harborline.llm import queries as q

    texts = {r.doc_id: r for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    bins, got = defaultdict(list), Counter()
    for r in q.op2_packing(spark, sf_small).collect():
        got[r.doc_id] += r.words
        bins[r.bin].append(r)
    assert got == {i: len(d.text.split()) for i, d in texts.items()}
    for rows in bins.values():
        assert sum(r.words for r in rows) <= p.CAPACITY
        assert max(Counter(texts[r.doc_id].source for r in rows).values()) <= p.SOURCE_REPEATS
        assert max(Counter(" ".join(texts[r.doc_id].text.lower().split()) for r in rows).values()) == 1
