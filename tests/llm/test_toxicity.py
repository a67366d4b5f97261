"""Toxicity: held-out accuracy, features against plain loops, edge cases."""

import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from harborline.llm import toxicity as t


def held(key):
    return zlib.crc32(str(key).encode()) % 4 == 2


@pytest.fixture(scope="module")
def made(spark):
    """Texts of common words; toxic ones hold a few of some words that others lack, one label in fifty is wrong."""
    rng = random.Random(1)
    common = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    rude = ["vile", "rotten", "foul"]
    docs, labels = [], []
    for key in range(1600):
        words = rng.choices(common, weights=[1 / (i + 1) for i in range(400)], k=rng.randint(5, 300))
        toxic = rng.random() < 0.15
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(rude)
        docs.append((key, " ".join(words)))
        labels.append((key, int(toxic != (rng.random() < 0.02))))
    return docs, labels


def run(spark, docs, labels):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    told = spark.createDataFrame(labels, "doc_id long, toxic int")
    return {r.doc_id: r for r in t.toxicity_scores(df, told).collect()}


def test_held_out_accuracy(spark, made):
    docs, labels = made
    rows = run(spark, docs, labels)
    assert all(r.held_out == held(k) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in rows.items())
    told = dict(labels)
    test = [k for k in told if held(k)]
    right = np.mean([rows[k].predicted == told[k] for k in test])
    assert len(test) > 300 and right > 0.93


def test_held_out_labels_play_no_part(spark, made):
    docs, labels = made
    turned = [(k, 1 - y if held(k) else y) for k, y in labels]
    a, b = run(spark, docs[:600], labels[:600]), run(spark, docs[:600], turned[:600])
    assert {k: r.score for k, r in a.items()} == {k: r.score for k, r in b.items()}


def test_edges(spark, made):
    docs, labels = made
    rows = run(spark, [*docs[:300], (None, "vile foul"), (9001, None), (9002, " \n"), (9003, "ab " * 200_000)], [*labels[:300], (None, 1), (5, None), (7, 1), (7, 0)])
    assert rows[9001].score == rows[9002].score and rows[None].held_out is False
    assert run(spark, docs[:3], []) and all(r.predicted == 0 for r in run(spark, docs[:3], []).values())
    df = spark.createDataFrame(docs[:3], "doc_id long, text string")
    told = spark.createDataFrame(labels[:3], "doc_id long, toxic int")
    assert t.toxicity_scores(df.limit(0), told).collect() == []


def test_features_by_plain_loops():
    rng = np.random.default_rng(2)
    sizes = [0, 1, 3, 70, 0, 200, 2]
    ratios = rng.normal(0, 2, sum(sizes))
    first = np.concatenate([[0], np.cumsum(sizes)])
    got = t.features(ratios, first)
    for i, n in enumerate(sizes):
        own = ratios[first[i] : first[i] + n]
        want = [own.sum() / max(n, 1)]
        for size in t.PASSAGES:
            sums = [own[k : k + size].sum() for k in range(max(n - size, 0) + 1)]
            want.append(max(sums) / size if n else 0)
        clear = np.clip(own - t.CLEAR, 0, t.MOST_CLEAR).sum()
        want += [np.log1p(clear), clear / max(n, 32), np.log1p(n) / 10]
        assert np.allclose(got[:, i], want)


def test_counts_are_once_a_text_and_of_all_texts(spark):
    texts = [(i, "a a a b" if i % 2 else "a b c") for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    ids = np.arange(40)
    counts = t.count_pairs(df, ids, ids % 2 == 1, "doc_id", "text")
    # Different pairs of a text: toxic (start a)(a a)(a b), ordinary (start a)(a b)(b c).
    assert counts.word[1].sum() == 60 and counts.word[0].sum() == 60
    assert counts.before.sum() == 4 and counts.pair.sum() == 120


def brute_ratios(texts, told, asked):
    """Log of toxic over ordinary likelihood of each pair asked for, by dictionaries of words."""
    pairs = [{*zip(["", *x.lower().split()], x.lower().split())} for x in texts]
    each = [Counter(p for i, own in enumerate(pairs) if told.get(i) == c for p in own) for c in (0, 1)]
    word = [Counter() for _ in each]
    kinds = [Counter(u for u, _ in own) for own in each]
    for c in (0, 1):
        for (_, w), n in each[c].items():
            word[c][w] += n
    before = Counter(w for _, w in set().union(*pairs))
    every = Counter(word[0]) + Counter(word[1])
    toxic, ordinary = t.DISCOUNTS[1], t.DISCOUNTS[0]
    freed = sum(min(n, toxic) for n in every.values()) / max(sum(every.values()), 1) if every else 1.0
    out = []
    for u, w in asked:
        shared = (before[w] + 0.5) / (sum(before.values()) + 0.5 * 2**t.WORD_BITS)
        began = kinds[0][u] + kinds[1][u]
        context = max(every[u], began)
        weight = max(min(1.0, toxic * began / context) if context else 1.0, 0.05)
        logs = []
        for c, discount in ((0, ordinary), (1, toxic)):
            alone = max(word[c][w] - discount, 0) / max(sum(word[c].values()), 1) + freed * shared
            seen = each[0][u, w] + each[1][u, w] >= 2
            own = max(each[c][u, w] - discount, 0) * seen / max(word[c][u], kinds[c][u], 1)
            logs.append(math.log(min(own, 1.0) + weight * alone))
        out.append(logs[1] - logs[0])
    return out


def test_probabilities_against_dictionaries(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeXYé", k=rng.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(0, 40))) for _ in range(300)]
    told = {i: int(i % 3 == 0) for i in range(300) if i % 4 != 2}  # the others' texts are read without a label
    ids = np.array(sorted(told))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    models = t.Models(t.count_pairs(df, ids, np.array([told[i] for i in ids]) > 0, "doc_id", "text"))
    models = pickle.loads(pickle.dumps(models))
    lower = str.maketrans("XY", "xy")
    for text in texts[:80]:
        word, before, pair, _ = t._cells(pa.array([text]))
        own = text.translate(lower).split()
        assert np.allclose(models.ratios(word, before, pair), brute_ratios(texts, told, list(zip(["", *own], own))), atol=1e-4)


def test_texts_without_a_label_only_fill_the_shared_counts(spark):
    df = spark.createDataFrame([(0, "a b"), (1, "c b"), (None, "d b"), (2, None)], "doc_id long, text string")
    counts = t.count_pairs(df, np.array([0]), np.array([True]), "doc_id", "text")
    assert counts.word[1].sum() == 2 and counts.word[0].sum() == 0 and counts.kinds.sum() == 2
    assert counts.before.max() == 3 and counts.before.sum() == 6
    none = t.count_pairs(df, np.zeros(0, np.int64), np.zeros(0, bool), "doc_id", "text")
    assert none.word.sum() == 0 and none.before.sum() == 6


def test_query_on_the_table(spark, sf_small):
    from harborline.llm import queries as q

    assert q.op3_toxicity(spark, sf_small).count() == spark.read.parquet(f"{sf_small}/documents.parquet").count()


def test_bundles_give_back_their_keys():
    rng = np.random.default_rng(3)
    for bits in (1, 5, 8):
        key = np.concatenate([rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2), np.array([0, 2**64 - 1], np.uint64)])
        key, counts = t._summed(np.concatenate([key, key[:200]]), rng.integers(0, 3, (2, len(key) + 200)).astype(np.int32) * (rng.random(len(key) + 200) < 0.1))
        assert (key[1:] > key[:-1]).all()
        rows = list(zip(*(c.to_pylist() for c in t._bundles(key, counts, bits).columns)))
        back = [t._unbundled(*r, bits) for r in rows]
        assert (np.concatenate([k for k, _ in back]) == key).all() and (np.concatenate([c for _, c in back], axis=1) == counts).all()
        assert len(rows) == len(set(r[0] for r in rows)) and all((k >> np.uint64(64 - bits) == r[0]).all() for r, (k, _) in zip(rows, back))
