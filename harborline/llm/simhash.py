"""SimHash fingerprints, and their near-duplicate classes by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import BitSieve, cut_lineage, pieces, subset, unused
from harborline.llm.components import components
from harborline.llm.words import mix

SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 3

#: The ring has 16 segments of 4 bits. With a budget of 3/16 bit for each segment, a chain's first 5
#: segments must agree, its first 10 may differ in one bit, its first 15 in two and all 16 in three.
SEGMENT_BITS, SEGMENTS = 4, 16
CHAIN = ((5, 0), (10, 1), (15, 2), (16, 3))
#: A bucket with more fingerprints than this is split by further segments of the ring.
SPLIT = 2048


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The 64-bit SimHash of each whole text: key and fp (long, the bits as they are).

    Words are runs between blanks, tabs and line ends, A-Z lowered; shingles of consecutive words joined by
    one blank count as often as they occur; fewer words make one shingle; none (or null) gives 0. A bit
    is set if more than half of the shingles' XXH64 (seed 42) have it.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        block = 1 << 15

        def fingerprint(value: bytes | None) -> int:
            words = (value or b"").lower().split()
            if not words:
                return 0
            count = max(len(words) - shingle_words + 1, 1)
            totals = np.zeros(64, np.int64)
            for at in range(0, count, block):  # long texts in blocks: 64 bytes of memory for each shingle
                part = words[at : at + block + shingle_words - 1] if count > 1 else words
                ranges = [part[i : len(part) - shingle_words + 1 + i] for i in range(shingle_words)]
                joined = map(b" ".join, zip(*ranges)) if count > 1 else [b" ".join(words)]
                hashes = np.array([digest(x, SEED) for x in joined], dtype=np.uint64)
                totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            bits = (totals * 2 > count).astype(np.uint8)
            return int(np.packbits(bits, bitorder="little").view(np.int64)[0])

        for batch in batches:
            for piece in pieces(batch):
                values = piece.column(1).cast(pa.binary())
                marks = [fingerprint(x.as_py()) for x in values]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(marks, pa.int64())], ["key", "fp"])

    rows = subset(docs, key, text).select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(score, "key long, fp long")


def _rotate(marks: np.ndarray, bits: int) -> np.ndarray:
    return marks if bits == 0 else (marks << np.uint64(bits)) | (marks >> np.uint64(64 - bits))


def _masks() -> list[list[int]]:
    """Which bits of a turned fingerprint make its key, for each of three levels of splitting.

    A viable chain agrees in its first 5 segments. Of the next 5 at most one differs, so with each of them left out in
    turn, the others agree for one of 5 variants. Of the 5 after them and those at most two differ, at most one
    of them among the former: 35 variants, whose 13 segments leave 12 bits to differ.
    """

    def bits(segments) -> int:
        return sum(0xF << (64 - SEGMENT_BITS * (i + 1)) for i in segments)

    second = [bits(set(range(10)) - {i}) for i in range(5, 10)]
    left_out = [(i, j) for j in range(10, 15) for i in range(5, j)]
    third = [bits(set(range(15)) - set(pair)) for pair in left_out]
    return [[bits(range(5))], second, third]


MASKS = _masks()


def bucket_of(turned: np.ndarray, start: int, mask: int) -> np.ndarray:
    """A number for the start and the masked bits, the start in its last 4 bits; a rare collision joins two buckets
    of one start, which costs comparisons and finds no false link."""
    mixed = mix((turned & np.uint64(mask)) ^ mix(np.full(1, mask ^ start, np.uint64)))
    return (mixed & ~np.uint64(0xF)) | np.uint64(start)


def candidate_buckets(marks: np.ndarray, crowded: Sequence[Callable[[np.ndarray], np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, marks) for each start on the ring: fingerprints of a viable chain share a bucket.

    `crowded` tells for one level after the other which buckets are too full; their fingerprints go to
    the buckets of the next level instead, all of them.
    """
    for start in range(SEGMENTS):
        rows = [(np.arange(len(marks)), _rotate(marks, start * SEGMENT_BITS))]
        for level, masks in enumerate(MASKS):
            following = []
            for at, turned in rows:
                for mask in masks:
                    bucket = bucket_of(turned, start, mask)
                    full = crowded[level](bucket) if level < len(crowded) else np.zeros(len(bucket), bool)
                    yield bucket[~full], marks[at[~full]]
                    if full.any():
                        following.append((at[full], turned[full]))
            if not following:
                break
            # One fingerprint may come from several full buckets of a level; one is enough.
            at = np.unique(np.concatenate([x for x, _ in following]))
            rows = [(at, _rotate(marks[at], start * SEGMENT_BITS))]


def _chain_holds(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chain that begins at `start` keeps within its budget all the way."""
    shift = (start * SEGMENT_BITS).astype(np.uint64)
    differs = a ^ b
    differs = np.where(shift == 0, differs, (differs << shift) | (differs >> ((np.uint64(64) - shift) & np.uint64(63))))
    good = np.ones(len(a), bool)
    for length, budget in CHAIN[:-1]:
        good &= np.bitwise_count(differs >> np.uint64(64 - SEGMENT_BITS * length)) <= budget
    return good


def _links_of(bucket: np.ndarray, start: np.ndarray, marks: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Within each bucket (equal values lie together) a forest over its linked fingerprints: child, root."""
    n = len(marks)
    root = np.arange(n)
    size = np.diff(np.append(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), n))
    left = np.repeat(np.cumsum(size), size) - np.arange(n) - 1  # rows of the same bucket that follow
    rows = np.flatnonzero(left >= 1)
    step = 1
    while len(rows):
        other = rows + step
        good = _chain_holds(marks[rows], marks[other], start[rows])
        a, b = rows[good], other[good]
        near = np.bitwise_count(marks[a] ^ marks[b]) <= distance
        a, b = a[near], b[near]
        while len(a):
            for side in (a, b):  # follow the trees to their roots
                while True:
                    up = root[side]
                    if (up == side).all():
                        break
                    side[:] = up
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                low, high = np.minimum(a, b), np.maximum(a, b)
                root[high] = low  # one of several proposals for a root wins, the others come round again
                a, b = low, high
        step += 1
        rows = rows[left[rows] >= step]
    while True:
        up = root[root]
        if (up == root).all():
            break
        root = up
    child = np.flatnonzero(root != np.arange(n))
    return marks[child], marks[root[child]]


def near_links(marks: DataFrame, distance: int = DISTANCE, split: int = SPLIT) -> DataFrame:
    """Links between different fingerprints (column fp, distinct) at most `distance` bits apart.

    Not all pairs: within each bucket a forest of links that joins the same fingerprints as all its
    links would, so rows stay below the number of keys. Buckets hold different fingerprints only; copies have been
    folded before. Buckets are counted first, and those with more than `split` fingerprints are dealt out by
    further segments before any row moves, and once more where that is not enough; then 52 of 64 bits are
    the same, so no bucket that a task holds has more than 4,096. Returns a, b (long, a > b in bucket order).
    """
    if distance > DISTANCE:
        raise ValueError(f"the ring's budget is {DISTANCE} bits")
    crowded: list[BitSieve] = []

    def spread(*columns: str):
        passes = [sieve.passes for sieve in crowded]

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for bucket, mark in candidate_buckets(own.view(np.uint64), [lambda b, p=p: p(b.view(np.int64)) for p in passes]):
                    found = {"bucket": bucket, "fp": mark}
                    yield pa.RecordBatch.from_arrays([pa.array(found[c].view(np.int64)) for c in columns], list(columns))

        return marks.select("fp").mapInArrow(emit, ", ".join(f"{c} long" for c in columns))

    for _ in MASKS[:-1]:
        sieve = BitSieve(spread("bucket").groupBy("bucket").count().where(F.col("count") > split), "bucket")
        if not sieve.count:
            break
        crowded.append(sieve)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def close(rows: np.ndarray) -> pa.RecordBatch:
            start = rows[0] & 0xF
            a, b = _links_of(rows[0], start, rows[1].view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            # The last bucket may go on in the next batch.
            cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            if cut:
                yield close(np.concatenate([*held, rows[:, :cut]], axis=1))
                held = []
            held.append(rows[:, cut:])
        if held:
            yield close(np.concatenate(held, axis=1))

    dealt = spread("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(link, "a long, b long").distinct()


def near_classes(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    distance: int = DISTANCE,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Key, fp and component of each row: the smallest key that links of at most `distance` bits reach.

    Copies fold into one row for each fingerprint before any search, so a group of copies that holds a third
    of the rows costs one key. Texts without words (null, empty, blank) share fingerprint 0 and are
    one class. Null keys take part but name no class unless no other key is reachable, and then the
    component is null. Repeated rows come out as often as they came in; an empty table gives none.
    Other columns play no part.
    """
    marked = cut_lineage(fingerprints(docs, shingle_words, key, text))
    folded = cut_lineage(marked.groupBy("fp").agg(F.min("key").alias("least")))
    links = near_links(folded, distance)
    roots = components(links)
    # Only linked fingerprints are in `roots`; the others are classes of their own.
    named = folded.join(roots, folded.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("fp", "component")
    return marked.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


def keep_one(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, distance: int = DISTANCE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of each near-duplicate class, that of the smallest key, with all its columns; see keep_least."""
    return keep_least(docs, near_classes(docs, shingle_words, distance, key, text), key)


def keep_least(docs: DataFrame, classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each class (key and component of each row) the row of the smallest key, with all its columns.

    Of rows that repeat this key one stays. Rows with a null key cannot be named and are passed on. Only rows
    that may have to go (and few others, see BitSieve) move to where this is decided. Other columns come through as
    they are, whatever their names; an empty table stays empty.
    """
    mark, own, rows_of, least = (unused(docs, name) for name in ("mark", "own", "rows_of", "least"))
    counted = cut_lineage(
        classes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(own))
        .agg(F.count("*").alias(rows_of), F.min("component").alias(least))
        .where((F.col(rows_of) > 1) | (F.col(own) != F.col(least)))
    )
    sieve = BitSieve(counted.select(F.xxhash64(own).alias("h")), "h")
    rows = docs.select("*", F.xxhash64(F.col(key).cast("long")).alias(mark))

    def sift(taken: bool):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hashes = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                yield batch.filter(pa.array(sieve.passes(hashes) == taken))

        return keep

    names = docs.columns
    clean = rows.mapInArrow(sift(False), rows.schema).select(*names)
    maybe = rows.mapInArrow(sift(True), rows.schema).join(counted, F.col(key) == F.col(own), "left")
    stay = maybe.where(F.col(own).isNull()).select(*names)
    repeated = maybe.where((F.col(own) == F.col(least)) & (F.col(rows_of) > 1)).dropDuplicates([own]).select(*names)
    return clean.unionByName(stay).unionByName(repeated)
