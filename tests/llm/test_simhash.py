"""SimHash classes against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from harborline.llm import simhash as s


def mark(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(marks, distance=3):
    """Root (an index) of each mark by comparing all pairs."""
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if bin(marks[i] ^ marks[j]).count("1") <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(marks))]


def same_split(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("split", [s.SPLIT, 30, 2, 0])
def test_links_join_what_all_pairs_join(spark, split):
    rng = random.Random(7)
    marks = {0, 2**64 - 1}
    for _ in range(120):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            marks.add(centre)
            for b in rng.sample(range(64), rng.randint(0, 4)):
                centre ^= 1 << b
    marks = sorted(marks)
    frame = spark.createDataFrame([(int(np.uint64(m).view(np.int64)),) for m in marks], "fp long").repartition(5)
    links = s.near_links(frame, split=split)
    rows = links.collect()
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 12 for a, b in rows)
    at = {int(np.uint64(m).view(np.int64)): i for i, m in enumerate(marks)}
    roots = {r.node: r.root for r in s.components(links).collect()}
    assert same_split([roots.get(f, f) for f in at], classes(marks))


def test_a_dense_ball_is_one_class_and_few_links(spark):
    centre = random.Random(1).getrandbits(64)
    marks = [centre] + [centre ^ 1 << a ^ 1 << b for a in range(64) for b in range(a)]
    frame = spark.createDataFrame([(int(np.uint64(m).view(np.int64)),) for m in marks], "fp long")
    links = s.near_links(frame)
    assert links.count() <= s.SEGMENTS * len(marks)
    assert {r.root for r in s.components(links).collect()} == {min(int(np.uint64(m).view(np.int64)) for m in marks)}


def test_documents(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=rng.randint(0, 400))) for _ in range(40)]
    docs = [(i * 3 + 1, t) for i, t in enumerate(base)]
    docs += [(200 + i, t + "\n") for i, t in enumerate(base[:10])] + [(i, t.upper()) for i, t in docs[:4]]
    docs += [(400 + i, t + " tail") for i, t in enumerate(base)]
    docs += [(0, None), (900, ""), (901, " \t"), (None, base[3]), (None, "alone alone alone alone"), (902, "ß É ß"), (903, "one"), (904, "a\x0bb\x0cc")]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, fp int").repartition(3)
    rows = s.near_classes(df).collect()
    want = [mark(t) for _, t in docs]
    roots = classes(want)
    least = {}
    for (key, _), r in zip(docs, roots):
        if key is not None:
            least[r] = min(least.get(r, key), key)
    expected = sorted(((k, int(np.uint64(m).view(np.int64)), least.get(r)) for (k, _), m, r in zip(docs, want, roots)), key=str)
    assert sorted((tuple(r) for r in rows), key=str) == expected
    kept = s.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(least.values())
    assert sum(r.doc_id is None for r in kept) == 2 and kept[0].fp == 5
    assert s.near_classes(df.limit(0)).collect() == [] == s.keep_one(df.limit(0)).collect()


def test_long_text_in_blocks(spark):
    text = " ".join(f"w{i % 5000}" for i in range(80_000))
    (row,) = s.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.fp == int(np.uint64(mark(text)).view(np.int64))


def test_query_on_the_table(spark, sf_small):
    from harborline.llm import queries as q

    rows = {r.doc_id: r for r in q.op7_simhash(spark, sf_small).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    marks = [mark(t) for _, t in docs]
    assert [rows[k].fingerprint for k, _ in docs] == [f"{m:016x}" for m in marks]
    assert same_split([rows[k].component_id for k, _ in docs], classes(marks))
    assert all(r.component_id <= k for k, r in rows.items())


def test_columns_named_as_the_operator_names_its_own(spark):
    df = spark.createDataFrame([(1, "a b c d", 7, 8, 9, 10, "x"), (2, "a b c d", 1, 2, 3, 4, "y")],
                               "doc_id long, text string, __hash int, __key int, own int, least int, mark string")
    (row,) = s.keep_one(df).collect()
    assert tuple(row) == (1, "a b c d", 7, 8, 9, 10, "x")
    clash = df.withColumnRenamed("__key", "OWN_").withColumnRenamed("__hash", "Rows_Of")
    assert tuple(s.keep_one(clash).first()) == tuple(row) and s.keep_one(clash).columns == clash.columns


def test_masks_share_a_key_for_every_viable_pair():
    """Any two fingerprints at most three bits apart meet in a bucket of each level for some start."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.uint64(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        marks = np.array([a, b])
        for level in range(3):
            crowded = [lambda x: np.ones(len(x), bool)] * level
            met = False
            for bucket, own in s.candidate_buckets(marks, crowded):
                both = [set(bucket[own == m].tolist()) for m in (a, b)]
                met = met or bool(both[0] & both[1])
            assert met


def test_a_hot_key_is_split_before_rows_move(spark, monkeypatch):
    """100,000 different fingerprints with the same first 20 bits."""
    rng = np.random.default_rng(5)
    marks = np.unique((np.uint64(0xABCDE) << np.uint64(44)) | rng.integers(0, 2**44, 100_000, dtype=np.uint64))
    close = marks[:500] ^ np.uint64(5)
    marks = np.unique(np.concatenate([marks, close]))
    frame = spark.createDataFrame([(int(m),) for m in marks.view(np.int64)], "fp long").repartition(4)
    real, most = s._links_of, s.SPLIT

    def watched(bucket, start, own, distance):
        if np.unique(bucket, return_counts=True)[1].max() > most:
            raise ValueError("a task holds a crowded bucket")
        return real(bucket, start, own, distance)

    monkeypatch.setattr(s, "_links_of", watched)
    with pytest.raises(Exception, match="crowded"):
        s.near_links(frame, split=10**9).count()
    links = {frozenset(map(int, r)) for r in s.near_links(frame).collect()}
    roots = {r.node: r.root for r in s.components(spark.createDataFrame([tuple(x) for x in links], "a long, b long")).collect()}
    one, two = (x.view(np.int64).tolist() for x in (close, close ^ np.uint64(5)))
    assert all(roots.get(a, a) == roots.get(b, b) for a, b in zip(one, two))
