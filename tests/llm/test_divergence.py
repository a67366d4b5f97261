"""The divergence audit against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from harborline.llm import divergence as d
from harborline.llm.words import split_words

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            over = [(whole[t] - own[s][t], t.encode(), t) for t in kept if counts[lang, s][t] > 0 and own[s][t] > whole[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(over)[:50])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(items)]
    return sorted(out)


def audited(df, **options):
    return sorted(tuple(r) for r in d.audit_sources(df, **options).collect())


def odd_rows():
    rng = random.Random(3)
    words = ["The", "THE", "the", "a-b_c", "x1y2z3", "ÀÉ", "日本語テキスト", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq"]
    words += ["é" * n for n in range(1, 12)] + ["q" * n for n in range(1, 30)]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 30)))
    rows = [(rng.choice(["en", "de", None, "x"]), rng.choice(["a", "b", "ü", None, "c d"]), rng.choice([None, "", text(), text()])) for _ in range(1200)]
    return rows + rows[:20] + [("solo", "s", "nothing kept"), ("two", "s", ""), ("two", "t", None)]


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_ROWS", 7), ("TILE_SOURCES", 2), ("CELLS", 20), ("SLICE_BYTES", 300)):
            monkeypatch.setattr(d, name, value)
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "lang string, source string, text string, term int, p string")
    assert audited(df.repartition(5)) == plain(rows)
    assert audited(df.limit(0)) == []


def test_a_hot_source_and_a_hot_word(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_ROWS", 50)
    rng = random.Random(8)
    words = ["w" + "".join(rng.choices("abcde", k=rng.randint(1, 20))) for _ in range(300)]
    rows = [("en", "hot" if i % 3 == 0 else f"s{i % 40}", "the " * 20 + " ".join(rng.choices(words, k=40))) for i in range(1500)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(7)
    assert audited(df) == plain(rows)


def test_runs_of_packed_terms():
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["a", "ab", "abcdefgh", "abcdefghi", "x" * 16, "x" * 17, "é" * 9, "y" * 40], k=200)) for _ in range(70)]
    group = np.array([rng.randrange(3) for _ in texts])
    words = split_words(pa.array(texts), d.TERM_BYTES)
    chosen, n, docs = d.term_runs(words, group)
    own = words.text_of()
    got = {(bytes(words.data[words.starts[i] : words.ends[i]]), group[own[i]]): (a, b) for i, a, b in zip(chosen, n, docs)}
    want = defaultdict(lambda: [0, 0])
    for text, g in zip(texts, group):
        for word, count in Counter(text.split()).items():
            want[word.encode(), g][0] += count
            want[word.encode(), g][1] += 1
    assert got == {k: tuple(x) for k, x in want.items()} and len(chosen) == len(got)


def test_radix_order_is_stable():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 500, dtype=np.uint64) & np.uint64(0xF0000F0000F00003)
    assert (d.radix_order(np.arange(500), keys) == np.argsort(keys, kind="stable")).all()


def test_shares_are_exact_for_huge_counts(spark):
    count, total, terms = 9 * 10**15 + 1, 10**16 + 7, 12345
    row = spark.range(1).select(
        d.share(*(d.F.lit(x).cast("long") for x in (count, total, terms)), 5, 10**9).alias("p")
    ).first()
    assert row.p == 1 + 10**9 * (count + 5) // (total + 5 * terms)
