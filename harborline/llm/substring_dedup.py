"""Removal of repeated passages: FM-indexes over content-routed shards, and windows judged by document order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import BitSieve, cut_lineage, pieces, subset
from harborline.llm.fm_index import FMIndex
from harborline.llm.words import Words, hash_runs, hash_words, mix, split_words, whole_runs

WINDOW_WORDS = 50
#: A window goes to the shard that its smallest run of so many words names: equal windows, equal shards.
ANCHOR_WORDS = 8
#: Words that one index holds.
SHARD_WORDS = 1 << 18
#: An anchor with more different stretches than this is dealt out window by window instead.
HOT_STRETCHES = 2000

_U = np.uint64
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)


@dataclass
class Stretches:
    """Longest series of windows with one anchor: its text's index, first word in the text, windows, two hashes, first word of all."""

    text: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    at: np.ndarray


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(max(count, 1), _U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def stretches_of(words: Words, window: int) -> Stretches:
    hashes = hash_words(words)
    anchor_words = min(ANCHOR_WORDS, window)
    least = hash_runs(hashes, anchor_words)
    width, reach = window - anchor_words + 1, 1
    while reach < width:  # least[i] covers `reach` runs from i on
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        reach += step
    inside = whole_runs(words.first, window)
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | fresh[1:]
    at, end = np.flatnonzero(fresh), np.flatnonzero(stop) + window
    forward, back = _powers(_STEP, len(hashes)), _powers(_BACK, len(hashes))
    upto = np.concatenate([np.zeros(1, _U), np.cumsum(hashes * forward, dtype=_U)])
    content = mix((upto[end] - upto[at]) * back[at] + (end - at).astype(_U)) if len(at) else np.zeros(0, _U)
    text = np.searchsorted(words.first, at, side="right") - 1
    return Stretches(text, at - words.first[text], end - at - window + 1, least[at] if len(at) else content, content, at)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _place_hash(doc: np.ndarray, version: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(mix(doc.view(_U)) * _U(3) + mix(version.view(_U)) * _U(5) + start.astype(_U))


def _integers(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False).astype(np.int64)


def _anchors(rows: DataFrame, window: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                s = stretches_of(split_words(piece.column(2)), window)
                yield pa.RecordBatch.from_arrays([_long(s.anchor), piece.column(0).take(pa.array(s.text))], ["anchor", "doc"])

    return rows.mapInArrow(emit, "anchor long, doc long")


def _occurrences(rows: DataFrame, window: int, shared: BitSieve) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                s = stretches_of(split_words(piece.column(2)), window)
                kept = np.flatnonzero(shared.passes(s.anchor))
                text = pa.array(s.text[kept])
                columns = [
                    _long(s.anchor[kept]), _long(s.content[kept]), piece.column(0).take(text), piece.column(1).take(text),
                    pa.array(s.start[kept]), pa.array(s.windows[kept]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "doc", "version", "start", "windows"])

    return rows.mapInArrow(emit, "anchor long, content long, doc long, version long, start long, windows long")


def _bodies(rows: DataFrame, window: int, wanted: BitSieve) -> DataFrame:
    """The words of the stretches that begin at a wanted place."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words = split_words(piece.column(2))
                s = stretches_of(words, window)
                doc, version = _integers(piece.column(0))[s.text], _integers(piece.column(1))[s.text]
                place = _place_hash(doc, version, s.start)
                kept = np.flatnonzero(wanted.passes(place))
                raw = words.data.tobytes()
                begin, end = words.starts[s.at[kept]], words.ends[s.at[kept] + s.windows[kept] + window - 2]
                body = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]
                columns = [_long(s.anchor[kept]), _long(s.content[kept]), _long(place[kept]), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "place", "body"])

    return rows.mapInArrow(emit, "anchor long, content long, place long, body binary")


_FLAGS = "anchor long, content long, begin long, end long"


def _flags(anchor: np.ndarray, content: np.ndarray, sizes: np.ndarray, flagged: np.ndarray, window: int) -> pa.RecordBatch:
    """Covered words of each stretch, as ranges within it, from a flag for each word that begins a covered window."""
    first = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(sizes)), sizes)
    begins, stops = flagged.copy(), flagged.copy()
    begins[1:] &= ~flagged[:-1] | (which[1:] != which[:-1])
    stops[:-1] &= ~flagged[1:] | (which[1:] != which[:-1])
    begin, stop = np.flatnonzero(begins), np.flatnonzero(stops)
    own = which[begin]
    columns = [pa.array(anchor[own]), pa.array(content[own]), pa.array(begin - first[own]), pa.array(stop - first[own] + window)]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "content", "begin", "end"])


def _by_index(bodies: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Rows come by anchor. Whole anchors fill a shard; its index is built, and its stretches run past it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0

        def close(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            anchor, content, doc = (_integers(table[name]) for name in ("anchor", "content", "doc"))
            words = split_words(table["body"].combine_chunks())
            hashes, sizes = hash_words(words), np.diff(words.first)
            index = FMIndex(hashes, sizes, doc, window)
            length, owner = index.matches(hashes, sizes)
            earlier = (length >= window) & (owner < np.repeat(doc, sizes))
            return _flags(anchor, content, sizes, earlier, window)

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = _integers(batch.column(0))
            cuts = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(anchor)]
            for begin, end in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(begin, end - begin)
                if held >= shard_words and waiting[-1].column(0)[0].as_py() != anchor[begin]:
                    yield close(waiting)
                    waiting, held = [], 0
                waiting.append(part)
                held += part.column(3).nbytes // 7 + part.num_rows
        if waiting:
            yield close(waiting)

    dealt = bodies.select("anchor", "content", "doc", "body").repartition("anchor").sortWithinPartitions("anchor", "doc")
    return dealt.mapInArrow(search, _FLAGS)


def _by_window(bodies: DataFrame, window: int) -> DataFrame:
    """For stretches of hot anchors: each window by two hashes of its own, so that no anchor gathers in one task."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "body"):
                words = split_words(piece.column(3))
                hashes = hash_words(words)
                inside = np.flatnonzero(whole_runs(words.first, window))
                row = np.searchsorted(words.first, inside, side="right") - 1
                one = hash_runs(hashes, window)[inside]
                two = hash_runs(mix(hashes + _U(1)), window)[inside]
                took = pa.array(row)
                begin = pa.array(inside - words.first[row])
                columns = [_long(one), _long(two), *(piece.column(i).take(took) for i in range(3)), begin]
                yield pa.RecordBatch.from_arrays(columns, ["one", "two", "anchor", "content", "doc", "begin"])

    rows = bodies.select("anchor", "content", "doc", "body").mapInArrow(
        emit, "one long, two long, anchor long, content long, doc long, begin long"
    )
    least = rows.groupBy("one", "two").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    found = rows.join(least.drop("most"), ["one", "two"]).where("doc > least")
    return found.select("anchor", "content", "begin", (F.col("begin") + window).alias("end"))


def covered_words(
    docs: DataFrame,
    window: int = WINDOW_WORDS,
    key: str = "doc_id",
    text: str = "text",
    shard_words: int = SHARD_WORDS,
    hot_stretches: int = HOT_STRETCHES,
) -> DataFrame:
    """Word ranges (doc, version, begin, end) of windows that also start in a document with a smaller key.

    version is xxhash64 of the text, for rows that share a key. Neighbouring windows with the same anchor, the
    smallest hash of ANCHOR_WORDS words in them, form a stretch. Anchors of one document only are left out. Of equal stretches the
    least key keeps its words, and all others are covered; that fold, which a group of copies ends in, is a partial minimum.
    Different stretches of an anchor are searched for in the FM-index of their shard.
    """
    rows = subset(docs, key, text).select(
        F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("version"), F.col(text).cast("string").alias("text")
    ).where("doc is not null and text is not null")
    both = _anchors(rows, window).groupBy("anchor").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    shared = BitSieve(both.where("least < most"), "anchor")
    seen = cut_lineage(_occurrences(rows, window, shared))
    # Of equal stretches, the place of least key stands for all.
    place = F.struct("doc", "version", "start")
    folded = cut_lineage(seen.groupBy("anchor", "content").agg(F.min(place).alias("place"), F.max("doc").alias("most")))
    copies = folded.where("most > place.doc").select("anchor", "content", F.col("place.doc").alias("least"))
    whole = seen.join(copies, ["anchor", "content"]).where("doc > least")
    whole = whole.select("doc", "version", F.col("start").alias("begin"), (F.col("start") + F.col("windows") + (window - 1)).alias("end"))

    many = folded.groupBy("anchor").agg(F.count("*").alias("stretches")).where("stretches > 1")
    chosen = folded.join(many, "anchor").select("anchor", "content", "place.*", "stretches")
    chosen = cut_lineage(chosen.mapInArrow(_with_hash, "anchor long, content long, doc long, place long, stretches long"))
    bodies = _bodies(rows, window, BitSieve(chosen, "place"))
    # A row of the sieve's making meets no chosen one; rows equal in all make one.
    met = cut_lineage(chosen.join(bodies.dropDuplicates(["anchor", "content", "place"]), ["anchor", "content", "place"]))
    flags = _by_index(met.where(F.col("stretches") <= hot_stretches), window, shard_words).unionByName(
        _by_window(met.where(F.col("stretches") > hot_stretches), window)
    )
    flags = flags.join(folded.select("anchor", "content", F.col("place.doc").alias("doc")), ["anchor", "content"])
    parts = seen.select("anchor", "content", "doc", "version", "start").join(flags, ["anchor", "content", "doc"])
    parts = parts.select("doc", "version", (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end")).alias("end"))
    return whole.unionByName(parts)


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchor, content, doc, version, start, stretches = batch.columns
        place = _place_hash(_integers(doc), _integers(version), _integers(start))
        yield pa.RecordBatch.from_arrays(
            [anchor, content, doc, _long(place), stretches], ["anchor", "content", "doc", "place", "stretches"]
        )


def _strip(value: str | None, ranges: list[tuple[int, int]]) -> tuple[int, int, str]:
    words = (value or "").encode().split()
    if not ranges:
        return len(words), 0, b" ".join(words).decode()
    gone = np.zeros(len(words) + 1, np.int64)
    for begin, end in ranges:
        gone[begin] += 1
        gone[end] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    return len(words), len(words) - int(kept.sum()), b" ".join([w for w, k in zip(words, kept.tolist()) if k]).decode()


_OUT = "doc long, n_words long, n_removed long, kept_sha256 string, kept string"


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW_WORDS,
    key: str = "doc_id",
    text: str = "text",
    keep_text: bool = True,
    **limits,
) -> DataFrame:
    """Each row without the words of any window that also starts in a document with a smaller key.

    Returns key, n_words, n_removed, kept_sha256 and kept (the words left, joined by one blank; null if keep_text is off).
    Windows of `window` words are taken from each whole text and judged on the input. Null and empty texts have no
    words; a row with a null key loses none and takes none from others; rows with equal keys take none from each other. A
    group of copies keeps one. An empty table gives no rows. Other columns play no part.
    """
    ranges = cut_lineage(covered_words(docs, window, key, text, **limits))
    cover = ranges.groupBy("doc", "version").agg(F.collect_set(F.struct("begin", "end")).alias("cover"))
    cover = cover.withColumn("place", F.xxhash64("doc", "version"))
    hit = BitSieve(ranges.select(F.xxhash64("doc", "version").alias("place")), "place")
    rows = subset(docs, key, text).select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("version", F.xxhash64("text")).withColumn("place", F.xxhash64("doc", "version"))

    def sift(taken: bool):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(hit.passes(_integers(batch.column(3))) == taken))

        return keep

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                done = [
                    _strip(value.as_py(), [(r["begin"], r["end"]) for r in cover.as_py() or []])
                    for value, cover in zip(piece.column(1), piece.column(2))
                ]
                columns = [
                    piece.column(0), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                    pa.array([hashlib.sha256(d[2].encode()).hexdigest() for d in done], pa.string()),
                    pa.array([d[2] if keep_text else None for d in done], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "n_words", "n_removed", "kept_sha256", "kept"])

    kind = cover.schema["cover"].dataType.simpleString()
    # Texts without a covered word go straight to their result; only the others move to meet their ranges.
    clean = rows.mapInArrow(sift(False), rows.schema).select("doc", "text", F.lit(None).cast(kind).alias("cover"))
    hits = rows.mapInArrow(sift(True), rows.schema).join(cover.drop("place"), ["doc", "version"], "left")
    both = [part.mapInArrow(finish, _OUT) for part in (clean, hits.select("doc", "text", "cover"))]
    return both[0].unionByName(both[1]).withColumnRenamed("doc", key)
