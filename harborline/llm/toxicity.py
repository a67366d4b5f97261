"""Toxicity by class-conditional Kneser-Ney models."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import Sent, pieces, subset
from harborline.llm.words import hash_words, mix, split_words

#: Labelled rows that the models are fitted on, at most: their ids go to every task, 9 bytes each. With more
#: labels, those whose id hashes lowest are taken.
FIT_ROWS = 400_000
#: Of the rows to fit on, one in so many is kept from the counts, to set the score's scale.
SCALE_FOLD = 5
#: Taken off each count of the ordinary and of the toxic class. The toxic class is small, and a rare expression comes up
#: in it by chance: up to so many texts say nothing. Any text speaks for the ordinary class.
DISCOUNTS = (0.75, 4.0)
#: An expression speaks for itself where its log ratio lies above this; so much of it counts at most.
CLEAR, MOST_CLEAR = 1.5, 2.0
THRESHOLD = 0.3
#: Words are told apart by 20 bits of their hash, and pairs seen twice or more by 22: the models' size is fixed.
WORD_BITS, PAIR_BITS = 20, 22
#: Lengths, in words, of the passages whose mean is taken beside the whole text's.
PASSAGES = (4, 16, 64)

_U = np.uint64
_WORDS, _PAIRS = 1 << WORD_BITS, 1 << PAIR_BITS
_START = 0  # the word before a text's first


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 4 == 2


@dataclass
class Counts:
    """What the texts hold, those labelled by class: toxic (1) or ordinary (0).

    A text counts a pair once, however often it repeats it. word: labelled texts, once for each word that stands before
    it there; pair: labelled texts, of pairs seen twice or more; kinds: different pairs that a word begins, in each
    class; before: different words before a word, in all texts, labelled or not, which is what both classes back off to.
    """

    word: np.ndarray
    pair: np.ndarray
    kinds: np.ndarray
    before: np.ndarray

    @classmethod
    def empty(cls) -> Counts:
        return cls(*(np.zeros(s, np.int32) for s in ((2, _WORDS), (2, _PAIRS), (2, _WORDS), _WORDS)))

    def stretches(self) -> Iterator[tuple[int, np.ndarray]]:
        """Views of all tables, CELLS cells at a time, numbered."""
        tables = (*self.word, *self.pair, *self.kinds, self.before)
        yield from enumerate(t[at : at + CELLS] for t in tables for at in range(0, len(t), CELLS))


def _cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word cells, cells of the words before them, full pair ids, and the index of each text's first word."""
    words = split_words(column)
    hashes = hash_words(words, fold_case=True)
    last = np.concatenate([np.zeros(1, _U), hashes[:-1]]) if len(hashes) else hashes
    begins = words.first[:-1][np.diff(words.first) > 0]
    last[begins] = _START
    shift = _U(64 - WORD_BITS)
    word, before = hashes >> shift, last >> shift
    mixed = mix(last * _U(0x9E3779B97F4A7C15) + hashes)
    pair = before << _U(43) | word << _U(23) | mixed >> _U(41)
    return word, before, pair, words.first


def _once(pair: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which pairs come up in their text for the first time."""
    order = np.lexsort((pair, row))
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (pair[order[1:]] != pair[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    out = np.empty(len(pair), bool)
    out[order] = fresh
    return out


def _pair_cell(pair: np.ndarray) -> np.ndarray:
    return (mix(pair) >> _U(64 - PAIR_BITS)).astype(np.int64)


#: Tables travel in stretches of so many cells.
CELLS = 1 << 18


def _pack(numbered: Iterable[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """Of numbered stretches of cells, those with any that isn't 0: places as steps and amounts, compressed."""
    rows = []
    for number, cells in numbered:
        at = np.flatnonzero(cells)
        if len(at):
            steps = np.diff(at, prepend=0).astype(np.uint32)
            rows.append((number, zlib.compress(steps.tobytes(), 1), zlib.compress(cells[at].astype(np.uint32).tobytes(), 1)))
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, ["stretch", "places", "amounts"])


def _unpack(places: bytes, amounts: bytes, into: np.ndarray) -> None:
    at = np.cumsum(np.frombuffer(zlib.decompress(places), np.uint32), dtype=np.int64)
    into[at] += np.frombuffer(zlib.decompress(amounts), np.uint32)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed stretches of one number added up."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, places, amounts in zip(*(c.to_pylist() for c in batch.columns)):
            _unpack(places, amounts, sums.setdefault(number, np.zeros(CELLS, np.int32)))
    yield _pack(sums.items())


def _summed(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, ascending, with their counts (a row for each class) added up."""
    order = np.argsort(key, kind="stable")
    key, counts = key[order], counts[:, order]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[heads], np.add.reduceat(counts, heads, axis=1) if len(key) else counts


def _bundles(key: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Ascending keys by their highest bits: steps from one to the next in as few bytes as they take, and counts."""
    shift = _U(64 - bits)
    bucket = key >> shift
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(key)]
    rows = []
    for begin, end in zip(cuts[:-1], cuts[1:]):
        steps = np.diff(key[begin:end], prepend=bucket[begin] << shift)
        size = max(1, -(-int(steps.max()).bit_length() // 8))
        own = counts[:, begin:end]
        packed = zlib.compress(own.astype("<i4").tobytes(), 1) if own.any() else b""
        rows.append((int(bucket[begin]), size, steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes(), packed))
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "size", "steps", "counts"])


def _unbundled(bucket: int, size: int, steps: bytes, counts: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((len(steps) // size, 8), np.uint8)
    wide[:, :size] = np.frombuffer(steps, np.uint8).reshape(-1, size)
    key = np.cumsum(wide.view("<u8").ravel(), dtype=_U) + (_U(bucket) << _U(64 - bits))
    return key, np.frombuffer(zlib.decompress(counts), "<i4").reshape(2, -1) if counts else np.zeros((2, len(key)), np.int32)


def count_pairs(docs: DataFrame, ids: np.ndarray, toxic: np.ndarray, key: str, text: str) -> Counts:
    """Counts over all texts; those of the given ids, whose order is ascending, count for their class.

    Tasks fold their own pairs and send them on in bundles, dealt by the mixed bits of a pair's hash over as many
    buckets as there are shuffle partitions, so no word is hot. What is shuffled grows with the different pairs of
    the corpus. A bucket's pairs are folded once more, each then counted once in tables of fixed size, of which what isn't 0 is
    passed on, packed.
    """
    session = docs.sparkSession
    held = session.sparkContext.broadcast((ids, toxic))
    bits = max(1, (int(session.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    most, mixed = 1 << 21, 23

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic = held.value
        waiting, size = [], 0

        def folded() -> pa.RecordBatch:
            pair, label = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
            # The pair's mixed bits first, so that its buckets are even.
            turned = pair << _U(64 - mixed) | pair >> _U(mixed)
            return _bundles(*_summed(turned, np.stack([label == 0, label == 1]).astype(np.int32)), bits)

        for batch in batches:
            label, done = _told(batch, ids, toxic), 0
            for piece in pieces(batch):
                _, _, pair, first = _cells(piece.column(1))
                row = np.repeat(np.arange(piece.num_rows), np.diff(first))
                once = _once(pair, row)
                pair, row = pair[once], row[once]
                waiting.append((pair, label[done + row]))
                done += piece.num_rows
                size += len(pair)
                if size >= most:
                    yield folded()
                    waiting, size = [], 0
        if size:
            yield folded()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bundles come by bucket."""
        sums = Counts.empty()
        waiting, done, size = [], [], 0

        def close() -> None:
            nonlocal waiting, size
            if waiting:
                done.append(_summed(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting], axis=1)))
                size += len(done[-1][0])
                waiting = []

        def tabulate() -> None:
            nonlocal done, size
            if not done:
                return
            turned, counts = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done], axis=1)
            pair = turned << _U(mixed) | turned >> _U(64 - mixed)
            word = ((pair >> _U(mixed)) & _U(_WORDS - 1)).astype(np.int64)
            sums.before += np.bincount(word, minlength=_WORDS)
            known = counts.any(axis=0)
            pair, word, counts = pair[known], word[known], counts[:, known]
            before = (pair >> _U(43)).astype(np.int64)
            often = counts.sum(0) >= 2
            cell = _pair_cell(pair[often])
            for c in (0, 1):
                sums.word[c] += np.bincount(word, counts[c], _WORDS).astype(np.int64)
                sums.kinds[c] += np.bincount(before, counts[c] > 0, _WORDS).astype(np.int64)
                sums.pair[c] += np.bincount(cell, counts[c][often], _PAIRS).astype(np.int64)
            done, size = [], 0

        last = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != last:
                    close()
                    last = row[0]
                    if size >= most:
                        tabulate()
                waiting.append(_unbundled(*row, bits))
        close()
        tabulate()
        yield _pack(sums.stretches())

    bundles = _keyed(docs, key, text).mapInArrow(own, "bucket long, size int, steps binary, counts binary")
    kind = "stretch int, places binary, amounts binary"
    counted = bundles.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, kind)
    # A task sums each stretch, so the tables come to the driver once, whatever the number of partitions.
    summed = counted.repartition("stretch").mapInArrow(_merge, kind)
    total = Counts.empty()
    stretches = dict(total.stretches())
    for row in summed.collect():
        _unpack(row.places, row.amounts, stretches[row.stretch])
    return total


class Models:
    """Two interpolated Kneser-Ney models over words and pairs, on shared backoff counts.

    P(w | u) = max(c(u w) - D, 0) / c(u) + g(u) P(w) and P(w) = max(c(w) - D, 0) / N + g S(w) with the counts and discount of
    one class. S, the share of different pairs that end in w, comes from all texts, labelled or not, and the weights g
    that the discounts free from both classes together: where neither class has more than its discount of an
    expression, both fall back on the same, and it says nothing for or against either.
    """

    def __init__(self, counts: Counts):
        shared = (counts.before + 0.5) / (counts.before.sum() + 0.5 * _WORDS)
        every, kinds = counts.word.sum(0), counts.kinds.sum(0)
        # As a context, a word occurs as often as it does at all, but for the ends and starts of texts.
        freed = np.minimum(every, DISCOUNTS[1]).sum() / max(int(every.sum()), 1) if every.any() else 1.0
        context = np.maximum(every, kinds)
        self.weight = np.where(context > 0, np.minimum(1.0, DISCOUNTS[1] * kinds / np.maximum(context, 1)), 1.0).astype(np.float32)
        self.weight = np.maximum(self.weight, np.float32(0.05))
        self.word, self.pair, self.each = [], [], []
        for c in (0, 1):
            n = counts.word[c]
            self.word.append((np.maximum(n - DISCOUNTS[c], 0) / max(int(n.sum()), 1) + freed * shared).astype(np.float32))
            self.each.append((1.0 / np.maximum(np.maximum(n, counts.kinds[c]), 1)).astype(np.float32))
            self.pair.append(np.maximum(counts.pair[c] - DISCOUNTS[c], 0).astype(np.float32))

    def __getstate__(self) -> dict:
        """Packed, as the tables are mostly empty where the corpus is small."""
        packed = lambda table: (table.dtype.str, zlib.compress(table.tobytes(), 1))
        return {"weight": packed(self.weight)} | {n: [packed(t) for t in getattr(self, n)] for n in ("word", "pair", "each")}

    def __setstate__(self, state: dict) -> None:
        plain = lambda kind, raw: np.frombuffer(zlib.decompress(raw), kind)
        self.weight = plain(*state["weight"])
        self.word, self.pair, self.each = ([plain(*t) for t in state[n]] for n in ("word", "pair", "each"))

    def ratios(self, word: np.ndarray, before: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Log of toxic over ordinary likelihood of each word after the one before it."""
        cell = _pair_cell(pair)
        word, before = word.astype(np.int64), before.astype(np.int64)
        logs = []
        for c in (0, 1):
            seen = np.minimum(self.pair[c][cell] * self.each[c][before], 1.0)
            logs.append(np.log(seen + self.weight[before] * self.word[c][word]))
        return (logs[1] - logs[0]).astype(np.float64)


def features(ratios: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the mean ratio over its length, the highest mean of any passage of PASSAGES words, what clearly
    toxic expressions add up to, alone and over the length, and the length.

    A shorter text's passage is filled up with words that say nothing; texts without words have zeros.
    """
    texts, words = len(first) - 1, len(ratios)
    size = np.diff(first)
    upto = np.concatenate([[0.0], np.cumsum(ratios)])
    total = upto[first[1:]] - upto[first[:-1]]
    out = [total / np.maximum(size, 1)]
    text = np.repeat(np.arange(texts), size)
    for length in PASSAGES:
        best = np.full(texts, -np.inf)
        if words:
            begin = np.arange(words)
            end = np.minimum(begin + length, first[1:][text])
            inside = (begin + length <= first[1:][text]) | (begin == first[:-1][text])
            mean = np.where(inside, (upto[end] - upto[begin]) / length, -np.inf)
            filled = np.flatnonzero(size > 0)
            best[filled] = np.maximum.reduceat(mean, first[:-1][filled])
        out.append(np.where(size > 0, best, 0.0))
    clear = np.concatenate([[0.0], np.cumsum(np.clip(ratios - CLEAR, 0, MOST_CLEAR))])
    clear = clear[first[1:]] - clear[first[:-1]]
    out += [np.log1p(clear), clear / np.maximum(size, 32), np.log1p(size) / 10]
    return np.stack(out)


N_FEATURES = len(PASSAGES) + 4


@dataclass
class Scorer:
    """The models, sent out once, and the scale that turns their ratios into a score."""

    models: Sent
    weights: np.ndarray
    offset: float

    def measured(self, column: pa.Array) -> np.ndarray:
        word, before, pair, first = _cells(column)
        ratios = self.models.value.ratios(word, before, pair)
        ratios[~_once(pair, np.repeat(np.arange(len(first) - 1), np.diff(first)))] = 0.0  # as in the counts
        return features(ratios, first)

    def scores(self, column: pa.Array) -> np.ndarray:
        logit = self.weights @ self.measured(column) + self.offset
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return subset(docs, key, text).select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))


def _told(batch: pa.RecordBatch, ids: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The class of each row, -1 for those whose key is none of ids (ascending)."""
    out = np.full(batch.num_rows, -1, np.int8)
    if len(ids) and batch.num_rows:
        keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(ids, keys), len(ids) - 1)
        known = (ids[at] == keys) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        out[known] = toxic[at[known]]
    return out


def _sample_features(
    docs: DataFrame, scorer: Scorer, ids: np.ndarray, y: np.ndarray, key: str, text: str
) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the texts with the given ids; FIT_ROWS bounds them."""
    held = docs.sparkSession.sparkContext.broadcast((ids, y))
    names = [f"f{i}" for i in range(N_FEATURES)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y = held.value
        for batch in batches:
            label, done = _told(batch, ids, y), 0
            label, rows = label[label >= 0], batch.filter(pa.array(label >= 0))
            for piece in pieces(rows):
                own = label[done : done + piece.num_rows].astype(float)
                done += piece.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(own), *map(pa.array, scorer.measured(piece.column(1)))], ["y", *names])

    table = _keyed(docs, key, text).mapInArrow(measure, ", ".join(f"{n} double" for n in ["y", *names])).toArrow()
    return np.stack([table[n].to_numpy() for n in names], axis=1), table["y"].to_numpy()


def fit_scale(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset that turn features into a probability: logistic regression by Newton steps."""
    if len(y) == 0:
        return np.zeros(x.shape[1]), -20.0
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.hstack([(x - mean) / spread, np.ones((len(y), 1))])
    ridge = np.diag([1.0] * x.shape[1] + [1e-3])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] / spread * mean).sum())


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> Scorer:
    """Models and scale from the labels of rows whose crc32 of the key as text, modulo 4, is not 2.

    The class counts come from four fifths of the labelled texts, the scale from the rest, and the shared backoff
    counts from all documents, whose labels play no part in them.
    """
    usable = (
        subset(labels, key, label)
        .where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
        .withColumn("rank", F.xxhash64("id"))
    )
    wanted = usable.count()
    if wanted > fit_rows:  # about fit_rows of them, by hash
        usable = usable.where(F.col("rank") < F.lit(int(-(2**63) + 2**64 * (fit_rows / wanted))))
    known = usable.select("id", "y", (F.pmod("rank", F.lit(SCALE_FOLD)) == 0).alias("scale")).toArrow().sort_by("id")
    ids, y, scale = (known[c].to_numpy() for c in ("id", "y", "scale"))
    scale = scale.astype(bool)
    models = Models(count_pairs(docs, ids[~scale], y[~scale] > 0, key, text))
    held = Sent(docs.sparkSession, models)
    x, told = _sample_features(docs, Scorer(held, np.zeros(N_FEATURES), 0.0), ids[scale], y[scale], key, text)
    return Scorer(held, *fit_scale(x, told))


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    fit_rows: int = FIT_ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Key, held_out, score (0 to 1) and predicted of each row.

    Every whole text is scored by length-normalised log-likelihood ratios, over the text and over its
    passages; a row's score depends on its text alone. Held-out labels are not learnt from.

    Null and empty texts get the score of a text without words; null keys are scored, never learnt from; a key with
    more than one label counts as toxic if any says so; repeated rows score alike. Without any label the
    score is near 0. An empty table gives no rows. Other columns play no part.
    """
    scorer = fit(docs, labels, key, text, label, fit_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                scores = pa.array(scorer.scores(piece.column(1)))
                yield pa.RecordBatch.from_arrays([piece.column(0), scores], ["key", "score"])

    scored = _keyed(docs, key, text).mapInArrow(score, "key long, score double")
    return scored.select(
        F.col("key").alias(key),
        F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows that score below the threshold, with all their columns; rows stay in their tasks.

    Null and empty texts score as in toxicity_scores and stay or go by that; repeated rows share their fate; null keys
    only mean that no label is theirs. Other columns come through whatever their names; an empty table stays empty.
    """
    scorer = fit(docs, labels, key, text, label)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for piece in pieces(batch, text):
                yield piece.filter(pa.array(scorer.scores(piece.column(at)) < threshold))

    return docs.mapInArrow(keep, docs.schema)
