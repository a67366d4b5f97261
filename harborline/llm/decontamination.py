"""Benchmark decontamination: short test items found inside documents by containment."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import Sent, cut_lineage, pieces, subset
from harborline.llm.words import hash_runs, hash_words, mix, split_words, whole_runs

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: Text of the items that one scan of the documents searches for; more items take more scans.
BLOCK_BYTES = 16 << 20
#: Sketch entries beyond those that a contained item may miss: so many must meet in a document.
SPARE = 3
_BITS = 20


def shingles(text: str, size: int) -> set[bytes]:
    """The different runs of `size` words, A-Z lowered, joined by one blank; none if there are fewer words."""
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def least_shared(count: int, containment: float) -> int:
    """How many of an item's shingles a document must hold."""
    return max(1, math.ceil(containment * count - 1e-9))


class Sketches:
    """MinHash sketches of a block of items, by size class.

    An item's sketch holds its smallest shingle hashes, so many as the size class (sizes up to the next power of two)
    may miss plus SPARE. A document that contains the share asked for misses at most the rest, so a known
    number of sketch entries is among its shingles whatever its length: the search drops no match.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], size: int, containment: float):
        self.size, self.containment = size, containment
        self.ids, self.texts, self.counts, self.hits = [], [], [], []
        entries, owners = [], []
        for item, text in items:
            own = np.unique(runs_of(pa.array([text or ""]), size)[0])
            if not len(own):
                continue
            count = len(own)
            largest = (1 << count.bit_length()) - 1
            sketch = min(count, largest - least_shared(largest, containment) + SPARE)
            ranked = own[np.argsort(mix(own), kind="stable")][:sketch]
            entries.append(ranked)
            owners.append(np.full(sketch, len(self.ids)))
            # Exact counts of different shingles decide; hashes only propose.
            self.counts.append(len(shingles(text or "", size)))
            self.hits.append(max(1, sketch - (count - least_shared(count, containment))))
            self.ids.append(item)
            self.texts.append(text)
        entry = np.concatenate(entries) if entries else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(entry, kind="stable")
        self.entry, self.owner = entry[order], owner[order]
        self.known = np.zeros(1 << _BITS, bool)
        self.known[self.entry >> np.uint64(64 - _BITS)] = True

    def matches(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) for each text and item it contains."""
        runs, row = runs_of(column, self.size)
        at = np.flatnonzero(self.known[runs >> np.uint64(64 - _BITS)])
        runs, row = runs[at], row[at]
        low, high = (np.searchsorted(self.entry, runs, side) for side in ("left", "right"))
        many = high - low
        if not many.any():
            return []
        entry = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        met = np.unique(np.stack([np.repeat(row, many), self.owner[entry], entry]), axis=1)
        pair, hits = np.unique(met[:2], axis=1, return_counts=True)
        found, last, own = [], -1, set()
        for (row, item), n in zip(pair.T.tolist(), hits.tolist()):
            if n < self.hits[item]:
                continue
            if row != last:
                last, own = row, shingles(column[row].as_py(), self.size)
            shared = len(own & shingles(self.texts[item], self.size))
            if shared >= least_shared(self.counts[item], self.containment):
                found.append((row, item, shared))
        return found


class Index:
    """Sketches of a block of items: those of `size` words or more, and shorter ones by their number of words,
    whose whole word sequence is their one shingle."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int, containment: float):
        by_size: dict[int, list] = {}
        for item, text in items:
            words = len((text or "").encode().split())
            if words:
                by_size.setdefault(min(words, size), []).append((item, text))
        self.parts = [Sketches(by_size[n], n, containment) for n in sorted(by_size)]

    def matches(self, column: pa.Array) -> list[tuple[int, int | None, int, int]]:
        """(row, item's key, shared shingles, item's shingles) for each text and item it contains."""
        return [(row, part.ids[item], n, part.counts[item]) for part in self.parts for row, item, n in part.matches(column)]


def runs_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words in each text, and the texts' indices."""
    words = split_words(column)
    inside = whole_runs(words.first, size)
    return hash_runs(hash_words(words, fold_case=True), size)[inside], words.text_of()[: len(inside)][inside]


def item_blocks(items: DataFrame, block_bytes: int, key: str, text: str) -> Iterator[list[tuple]]:
    """The items, in as many blocks as keep each near block_bytes, one after the other."""
    rows = subset(items, key, text).select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = 1 + int(total) // block_bytes
    for block in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == block)
        yield [(r.k, r.t) for r in part.distinct().toLocalIterator()]


def find_contained(
    docs: DataFrame,
    items: DataFrame,
    size: int = SHINGLE_WORDS,
    containment: float = CONTAINMENT,
    block_bytes: int = BLOCK_BYTES,
    key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """Every document and item it contains: key, item_key, shared, of (counts of shingles) and containment.

    An item is contained if at least the share `containment` of its different shingles of `size` words occurs in the
    document, A-Z lowered. Each block of items is searched for in one scan of the documents, without
    any shuffle, so neither a hot source nor an item in a third of the documents gathers anywhere; texts
    are handled a piece at a time, the longest in one.

    An item with fewer words than `size` has its whole word sequence as its one shingle, which is looked for among the
    document's runs of that length; one without words is never found, and neither is anything in a null or empty
    text. Null and repeated keys come out as they are; repeated items (equal key and text) count once. Empty
    tables give no rows. Other columns play no part.

    With one block the result is lazy. With more, each block's is written to the checkpoint folder and its broadcast freed before
    the next is made, so that one block at a time is on the driver and the executors.
    """
    schema = "doc long, item long, shared int, of int"
    rows = subset(docs, key, text).select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))

    def part(held: Sent) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch):
                    hits = held.value.matches(piece.column(1))
                    if hits:
                        keys = piece.column(0).take(pa.array([h[0] for h in hits]))
                        columns = [
                            keys, pa.array([h[1] for h in hits], pa.int64()),
                            pa.array([h[2] for h in hits], pa.int32()), pa.array([h[3] for h in hits], pa.int32()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["doc", "item", "shared", "of"])

        return rows.mapInArrow(search, schema)

    found = reduce(DataFrame.unionByName, _by_block(docs, items, size, containment, block_bytes, item_key, text, part))
    return found.select(
        F.col("doc").alias(key), F.col("item").alias(item_key), "shared", "of", (F.col("shared") / F.col("of")).alias("containment")
    )


def _by_block(docs, items, size, containment, block_bytes, item_key, text, work: Callable[[Sent], DataFrame]) -> Iterator[DataFrame]:
    """What `work` makes of each block's index; of more than one block, each written before the next is made."""
    blocks = item_blocks(items, block_bytes, item_key, text)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        yield work(Sent(docs.sparkSession, Index(block, size, containment)))
        return
    for block in itertools.chain([block, following], blocks):
        held = Sent(docs.sparkSession, Index(block, size, containment))
        yield cut_lineage(work(held))
        held.drop()


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    size: int = SHINGLE_WORDS,
    containment: float = CONTAINMENT,
    block_bytes: int = BLOCK_BYTES,
    item_key: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """The documents that contain no item, with all their columns; rows stay in their tasks.

    Null and empty texts contain nothing and stay; repeated rows share their fate; null keys don't matter. Other columns come
    through whatever their names; an empty table stays empty. Of more than one block of items, each writes what it leaves
    to the checkpoint folder before the next is searched for.
    """
    schema = docs.schema

    def part(held: Sent) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index(text)
                for piece in pieces(batch, text):
                    clean = np.ones(piece.num_rows, bool)
                    clean[[hit[0] for hit in held.value.matches(piece.column(at))]] = False
                    yield piece.filter(pa.array(clean))

        return left.mapInArrow(keep, schema)

    left = docs
    for left in _by_block(docs, items, size, containment, block_bytes, item_key, text, part):
        pass
    return left
