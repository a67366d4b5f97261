"""Contained items against sets of shingles."""

import random

import pytest

from harborline.llm import decontamination as d


def brute(docs, items, size, share):
    found = set()
    for key, text in docs:
        for item, words in items:
            length = min(size, len((words or "").split()))
            own, want = (d.shingles(x or "", length) if length else set() for x in (text, words))
            if want and len(own & want) >= share * len(want) - 1e-9:
                found.add((key, item, len(own & want), len(want)))
    return found


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_random_texts(spark, block_bytes):
    rng = random.Random(3)
    word = lambda: rng.choice("ab cd Ef gh ij kl mn op qr st uv wx".split()) + str(rng.randint(0, 3))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(25)] + [(90, None), (91, "")]
    docs = []
    for key in range(120):
        words = [word() for _ in range(rng.randint(0, 400))]
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items[:25])[1].split()
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = word()
            at = rng.randint(0, len(words))
            words[at:at] = part[: rng.randint(len(part) * 3 // 4, len(part))]
        docs.append((key, "\n".join(words).upper() if key % 9 == 0 else "  ".join(words)))
    docs += [(None, items[7][1] * 2), (500, None), (501, ""), (502, " ".join(w for _, t in items[:25] for w in t.split()))]
    df = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = d.find_contained(df, tests, block_bytes=block_bytes)
    assert found.columns == ["doc_id", "item_id", "shared", "of", "containment"]
    got = {tuple(r)[:4] for r in found.collect()}
    want = brute(docs, items, 5, 0.8)
    assert got == want and len(want) > 30
    kept = {r.doc_id for r in d.drop_contaminated(df, tests, block_bytes=block_bytes).collect()}
    assert kept == {k for k, _ in docs} - {k for k, *_ in want}


def test_repeated_and_empty(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    tests = spark.createDataFrame([(1, text), (1, text)], "item_id long, text string")
    assert len(d.find_contained(df, tests).collect()) == 2
    assert d.find_contained(df.limit(0), tests).collect() == [] == d.find_contained(df, tests.limit(0)).collect()


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_items_of_one_to_four_words(spark, block_bytes):
    items = [(1, "Zebra"), (2, "two words"), (3, "just three words"), (4, "exactly four words here"), (5, "these are five words now"), (6, " ")]
    docs = [
        (10, "a zebra ran"), (11, "two, words"), (12, "TWO\nwords"), (13, "just three wordsy"), (14, "x just three words"),
        (15, "exactly four words here"), (16, "exactly four words"), (17, "and these are five words now"), (18, ""), (19, None),
    ]
    df = spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id long, text string, item_id string, own int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[:4] for r in d.find_contained(df, tests, block_bytes=block_bytes).collect()}
    assert got == brute(docs, items, 5, 0.8) == {(10, 1, 1, 1), (12, 2, 1, 1), (14, 3, 1, 1), (15, 4, 1, 1), (17, 5, 1, 1)}
    left = d.drop_contaminated(df, tests, block_bytes=block_bytes)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {11, 13, 16, 18, 19}
    assert d.drop_contaminated(df.limit(0), tests, block_bytes=block_bytes).collect() == []


def test_one_block_at_a_time_is_held(spark, monkeypatch):
    dropped = []
    real = d.Sent.drop
    monkeypatch.setattr(d.Sent, "drop", lambda self: (dropped.append(1), real(self)))
    items = [(i, f"item number {i} has its own words and some more {i}") for i in range(30)]
    docs = [(i, f"before {items[i][1]} after" if i % 2 else "nothing here at all to see") for i in range(30)]
    df, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = d.find_contained(df, tests, block_bytes=100)
    assert len(dropped) > 5
    assert {tuple(r)[:4] for r in found.collect()} == brute(docs, items, 5, 0.8)
