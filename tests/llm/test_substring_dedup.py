"""Repeated passages against every window of every text."""

import hashlib
import random

import pytest

from harborline.llm import substring_dedup as s


def brute(docs, window):
    """(n_words, n_removed, kept) of each row by a table of all windows."""
    split = [((text or "").encode().split(), key) for key, text in docs]
    first = {}
    for words, key in split:
        if key is not None:
            for i in range(len(words) - window + 1):
                name = tuple(words[i : i + window])
                first[name] = min(first.get(name, key), key)
    out = []
    for words, key in split:
        gone = set()
        if key is not None:
            for i in range(len(words) - window + 1):
                if first[tuple(words[i : i + window])] < key:
                    gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs, window, **limits):
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, version int")
    rows = s.remove_repeats(df, window, keep_text=False, **limits).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=str)


def texts(seed, window, letters, count=60):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(letters))
    passages = [[word() for _ in range(rng.randint(window - 2, 3 * window))] for _ in range(4)]
    docs = []
    for key in range(count):
        words = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.5:
                passage = rng.choice(passages)
                words += passage[rng.randint(0, 3) : len(passage) - rng.randint(0, 3)]
            words += [word() for _ in range(rng.randint(0, 2 * window))]
        docs.append((rng.randrange(3 * count), rng.choice([" ", "\n", "\t "]).join(words)))
    docs += [(key + 200, text) for key, text in docs[:8]] + docs[8:12]  # copies, and repeated rows
    docs += [(None, docs[0][1]), (None, None), (900, None), (901, ""), (902, "é " * 400), (903, "é " * 300), (904, "x " * window * 3)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("window, letters", [(50, 500), (10, 3), (6, 2), (12, 40)])
def test_random_texts(spark, window, letters):
    docs = texts(window, window, letters)
    want = brute(docs, window)
    assert run(spark, docs, window) == want
    assert sum(w[2] for w in want) > 500


@pytest.mark.parametrize("limits", [{"hot_stretches": 1}, {"shard_words": 40}, {"hot_stretches": 3, "shard_words": 100}])
def test_every_way_gives_the_same(spark, limits):
    docs = texts(9, 10, 6)
    assert run(spark, docs, 10, **limits) == brute(docs, 10)


def test_empty_and_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c d y")], "doc_id long, text string")
    assert s.remove_repeats(df.limit(0), 3).collect() == []
    assert {r.doc_id: r.kept for r in s.remove_repeats(df, 3).collect()} == {1: "a b c d e", 2: "x y"}
