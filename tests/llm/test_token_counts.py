"""Token counts against a plain greedy split."""

import random

from harborline.llm import token_counts as t


def greedy(word, vocabulary):
    count, at = 0, 0
    while at < len(word):
        size = next((n for n in range(len(word) - at, 0, -1) if word[at : at + n] in vocabulary), 1)
        at, count = at + size, count + 1
    return count


def brute(text, vocabulary):
    words = (text or "").encode().split()
    return len(words), sum(greedy(b" " + w, vocabulary) for w in words)


def test_random_vocabularies(spark):
    rng = random.Random(5)
    for _ in range(4):
        vocabulary = {bytes(rng.choices(b" ab\xc3\xa9c", k=rng.randint(1, 7))) for _ in range(rng.randint(0, 80))}
        texts = ["".join(rng.choices("abcé \n", k=rng.randint(0, 60))) for _ in range(80)] + [None, "", " \t", "a" * 3000]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: (r.n_words, r.n_tokens) for r in t.count_tokens(df, vocabulary).collect()}
        assert got == {i: brute(x, vocabulary) for i, x in enumerate(texts)}


def test_edges(spark):
    df = spark.createDataFrame([(None, "ab", 1), (1, "ab", 2), (1, "ab", 2)], "doc_id long, text string, n_tokens int")
    assert sorted(tuple(r)[1:] for r in t.count_tokens(df, [b" ab"]).collect()) == [(1, 1)] * 3
    assert t.count_tokens(df.limit(0), [b" ab"]).collect() == []


def test_query_on_the_table(spark, sf_small):
    from harborline.llm import queries as q

    vocabulary = set(t.read_vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in q.op9_token_counts(spark, sf_small).collect()}
    assert got == {i: brute(x, vocabulary) for i, x in texts.items()}
