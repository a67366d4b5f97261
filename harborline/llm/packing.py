"""Packing of texts into training sequences: best fit among the bins that no conflict rules out."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import cut_lineage, pieces
from harborline.llm.words import hash_words, mix, split_words

#: Words of a bin.
CAPACITY = 2048
#: Documents of one source that a bin may hold. Of a cluster of copies it holds one.
SOURCE_REPEATS = 2
#: Documents that are packed together; more make more blocks, side by side.
BLOCK_ROWS = 8192

_U = np.uint64


class Bins:
    """Open bins in order of the room they have left, each with bitmaps of its sources and clusters.

    A document goes to the first bin from its own size on, in that order, whose bitmaps have none of its bits: the
    tightest that is compatible. Without one it opens a bin. The last of the source's `repeats` bitmaps tells whether
    the bin has as many of it as it may.
    """

    def __init__(self, capacity: int, repeats: int):
        self.capacity, self.repeats = capacity, repeats
        self.order: list[tuple[int, int]] = []  # (room left, bin)
        self.sources: list[list[int]] = []
        self.clusters: list[int] = []
        self.filled: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and the place in it of something with these bits (0: none)."""
        order, sources, clusters, last = self.order, self.sources, self.clusters, self.repeats - 1
        at = bisect_left(order, (size, -1))
        while at < len(order):
            number = order[at][1]
            if not (sources[number][last] & source or clusters[number] & cluster):
                del order[at]
                break
            at += 1
        else:
            number = len(self.filled)
            sources.append([0] * self.repeats)
            clusters.append(0)
            self.filled.append(0)
        layers = sources[number]
        for i in range(self.repeats if source else 0):  # the first bitmap that lacks the bit takes it
            if not layers[i] & source:
                layers[i] |= source
                break
        clusters[number] |= cluster
        place = self.filled[number]
        self.filled[number] = place + size
        insort(order, (self.capacity - place - size, number))
        return number, place


def pack_block(
    sizes: Sequence[int], sources: Sequence[int | None], clusters: Sequence[int | None], capacity: int, repeats: int
) -> list[tuple[int, int, int, int, int]]:
    """(row, begin, words, bin, place) of each piece of each row, the largest rows first.

    A row longer than a bin fills bins of its own and its rest is packed like any other row.
    """
    bins = Bins(capacity, repeats)
    bit = {s: 1 << i for i, s in enumerate(sorted({s for s in sources if s is not None}))}
    many = sorted(c for c, n in Counter(c for c in clusters if c is not None).items() if n > 1)
    mark = {c: 1 << i for i, c in enumerate(many)}
    out = []
    for row in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        begin, own, shared = 0, bit.get(sources[row], 0), mark.get(clusters[row], 0)
        while sizes[row] - begin > 0:
            words = min(capacity, sizes[row] - begin)
            out.append((row, begin, words, *bins.put(words, own, shared)))
            begin += words
    return out


def _measure(docs: DataFrame, key: str, text: str, source: str, cluster: str | None) -> DataFrame:
    """Key, words, source and cluster of each row. Without a cluster column, texts with equal words make one, A-Z lowered."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words = split_words(piece.column(1))
                size = np.diff(words.first)
                columns = [piece.column(0), pa.array(size), piece.column(2), piece.column(3)]
                if cluster is None:
                    hashes = hash_words(words, fold_case=True)
                    nth = np.arange(len(hashes)) - np.repeat(words.first[:-1], size)
                    upto = np.concatenate([np.zeros(1, _U), np.cumsum(mix(hashes + nth.astype(_U) * _U(0x9E3779B97F4A7C15)), dtype=_U)])
                    own = mix(upto[words.first[1:]] - upto[words.first[:-1]] + size.astype(_U))
                    columns[3] = pa.array(own.view(np.int64), mask=size == 0)
                yield pa.RecordBatch.from_arrays(columns, ["key", "size", "source", "cluster"])

    shared = F.lit(None).cast("long") if cluster is None else docs[cluster].cast("long")
    rows = docs.select(
        docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"),
        docs[source].cast("string").alias("source"), shared.alias("cluster"),
    )
    return rows.mapInArrow(count, "key long, size long, source string, cluster long")


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    source_repeats: int = SOURCE_REPEATS,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cluster: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every row's place in bins of `capacity` words: key, begin, words, bin, place.

    No bin holds two rows of one duplicate cluster (equal texts, or the cluster column's) or more than source_repeats of one
    source; among the bins that this leaves, the tightest is taken, larger rows first. A row longer than a bin is
    cut into pieces: begin is a piece's first word, place its first word in the bin. Rows are dealt into blocks by
    hash and each block is packed on its own, so a hot source or cluster is spread evenly; only key, size, source and
    cluster move. Nothing is cut off or left out.

    A text without words (or null) takes no room: one row with bin and place null. A null source or cluster conflicts
    with nothing. Null keys and repeated rows are packed one by one; a block of more than twice block_rows (repeated rows
    hash alike) is packed in portions. Ties go by key. An empty table gives no rows. Other columns play no part.
    """
    rows = cut_lineage(_measure(docs, key, text, source, cluster))
    blocks = max(1, -(-rows.count() // block_rows))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        portion = 0

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            sizes = table["size"].to_pylist()
            placed = pack_block(sizes, table["source"].to_pylist(), table["cluster"].to_pylist(), capacity, source_repeats)
            base = (table["block"][0].as_py() << 32) + (portion << 20)
            empty = [i for i, n in enumerate(sizes) if n == 0]
            row = [p[0] for p in placed] + empty
            none = [None] * len(empty)
            columns = [
                table["key"].combine_chunks().take(pa.array(row, pa.int64())),
                pa.array([p[1] for p in placed] + [0] * len(empty), pa.int64()),
                pa.array([p[2] for p in placed] + [0] * len(empty), pa.int64()),
                pa.array([base + p[3] for p in placed] + none, pa.int64()),
                pa.array([p[4] for p in placed] + none, pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["key", "begin", "words", "bin", "place"])

        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for begin, end in zip(cuts[:-1], cuts[1:]):
                while begin < end:
                    if waiting:
                        held = sum(w.num_rows for w in waiting)
                        other = waiting[-1].column(0)[0].as_py() != block[begin]
                        if other or held >= 2 * block_rows:
                            yield close()
                            waiting.clear()
                            portion = 0 if other else portion + 1
                    room = 2 * block_rows - sum(w.num_rows for w in waiting)
                    part = batch.slice(begin, min(end - begin, room))
                    waiting.append(part)
                    begin += part.num_rows
        if waiting:
            yield close()

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key", "size", "cluster"), F.lit(blocks)).cast("long"))
    dealt = dealt.select("block", "key", "size", "source", "cluster").repartition("block")
    dealt = dealt.sortWithinPartitions("block", F.desc("size"), "key", "cluster", "source")
    return dealt.mapInArrow(fill, "key long, begin long, words long, bin long, place long").withColumnRenamed("key", key)
