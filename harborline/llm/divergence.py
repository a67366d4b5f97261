"""How far the sources of a language differ in their words: counts from length-bucketed packed terms, exact sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.common import cut_lineage, pieces
from harborline.llm.words import Words, split_words

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Text bytes whose terms are sorted together.
SLICE_BYTES = 1 << 21
#: Rows of a block of terms, and sources of a tile, that one task compares; cells of its dense part at a time.
BLOCK_ROWS, TILE_SOURCES, CELLS = 100_000, 256, 1 << 21

#: Bytes that terms are made of: ASCII letters, and all that is beyond ASCII.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def radix_order(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """`order` sorted by its keys (unsigned), stable: one counting pass for each 16 bits that differ at all."""
    for shift in range(0, 64, 16):
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        if len(digit) and (digit != digit[0]).any():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def _bytes_of(words: Words, chosen: np.ndarray, width: int) -> np.ndarray:
    """A row of `width` bytes for each chosen word, zeros behind it."""
    at = words.starts[chosen][:, None] + np.arange(width)
    inside = at < words.ends[chosen][:, None]
    return np.where(inside, words.data[np.minimum(at, len(words.data) - 1)], 0).astype(np.uint8)


def _counted(order: np.ndarray, new_term: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """From terms in order: one word of each run of term and group, the run's length and its documents."""
    g, d = group[order], doc[order]
    new_group = new_term.copy()
    new_group[1:] |= g[1:] != g[:-1]
    new_doc = new_group.copy()
    new_doc[1:] |= d[1:] != d[:-1]
    starts = np.flatnonzero(new_group)
    return order[starts], np.diff(np.append(starts, len(order))), np.add.reduceat(new_doc, starts, dtype=np.int64)


def term_runs(words: Words, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each different (term, group) the index of one of its words, its occurrences and its documents.

    `group` numbers the group of each text. Terms are dealt to buckets by length. Up to 8 bytes are one 64-bit
    word and up to 16 two, most significant byte first; these are sorted by radix, 16 bits a pass, and equal
    neighbours counted. Longer terms have a bucket for each length, sorted as bytes. No term holds a
    zero byte, so padding makes none equal.
    """
    doc = words.text_of()
    own = group[doc]
    lengths = words.ends - words.starts
    out = []
    for low, high, width in ((1, 8, 1), (9, 16, 2)):
        chosen = np.flatnonzero((lengths >= low) & (lengths <= high))
        if not len(chosen):
            continue
        packed = _bytes_of(words, chosen, 8 * width).view(">u8").astype(np.uint64)
        order = radix_order(np.arange(len(chosen)), own[chosen].astype(np.uint64))
        for part in reversed(range(width)):
            order = radix_order(order, packed[:, part])
        ordered = packed[order]
        new = np.ones(len(order), bool)
        new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        first, n, docs = _counted(order, new, own[chosen], doc[chosen])
        out.append((chosen[first], n, docs))
    longer = np.flatnonzero(lengths > 16)
    longer = longer[np.argsort(lengths[longer], kind="stable")]
    cuts = np.flatnonzero(np.r_[True, np.diff(lengths[longer]) > 0, True]) if len(longer) else []
    for begin, end in zip(cuts[:-1], cuts[1:]):
        chosen = longer[begin:end]
        width = int(lengths[chosen[0]])
        packed = _bytes_of(words, chosen, width).view(f"S{width}").ravel()
        order = radix_order(np.arange(len(chosen)), own[chosen].astype(np.uint64))
        order = order[np.argsort(packed[order], kind="stable")]
        new = np.ones(len(order), bool)
        new[1:] = packed[order][1:] != packed[order][:-1]
        first, n, docs = _counted(order, new, own[chosen], doc[chosen])
        out.append((chosen[first], n, docs))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _lowered(words: Words) -> Words:
    upper = (words.data >= 0x41) & (words.data <= 0x5A)
    return Words(np.where(upper, words.data | 0x20, words.data), words.starts, words.ends, words.first)


def _terms(words: Words, chosen: np.ndarray) -> pa.Array:
    lengths = words.ends[chosen] - words.starts[chosen]
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(words.starts[chosen] - (ends - lengths), lengths)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(chosen), pa.py_buffer(offsets.tobytes()), pa.py_buffer(words.data[at].tobytes()))


def count_terms(docs: DataFrame) -> DataFrame:
    """Occurrences (n) and documents (docs) of each lang, source and term; lang, source and text without nulls."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, size=SLICE_BYTES):
                lang, source = (piece.column(i).dictionary_encode() for i in (0, 1))
                codes = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                names, group = np.unique(codes, return_inverse=True)
                words = _lowered(split_words(piece.column(2), TERM_BYTES))
                chosen, n, docs = term_runs(words, group)
                own = names[group[words.text_of()[chosen]]]
                columns = [
                    lang.dictionary.take(pa.array(own // len(source.dictionary))),
                    source.dictionary.take(pa.array(own % len(source.dictionary))),
                    _terms(words, chosen), pa.array(n.astype(np.int64)), pa.array(docs),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    spread = docs.select("lang", "source", "text").mapInArrow(emit, "lang string, source string, term string, n long, docs long")
    return spread.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * terms)), exact: decimals before one whole division."""
    above = F.lit(scale).cast("decimal(12,0)") * (count + smoothing).cast("decimal(20,0)")
    below = (total + terms * smoothing).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def _pair_sums(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of absolute differences over one block of terms between the sources of two tiles.

    Rows without a term give a source's share where it lacks a term; the others the shares of the block's terms.
    """
    lang, _, low, high = (x.as_py() for x in key)
    source = np.array(table["source"].to_pylist(), object)
    tile, p = table["tile"].to_numpy(), table["p"].to_numpy()
    is_term = ~np.asarray(table["term"].is_null())
    lacking = {s: (t, v) for s, t, v in zip(source[~is_term], tile[~is_term], p[~is_term])}
    # Both tiles side by side, the lower first; within one tile each pair once, by name.
    names = sorted(lacking, key=lambda s: (lacking[s][0], s.encode()))
    at = {s: i for i, s in enumerate(names)}
    base = np.array([lacking[s][1] for s in names], np.int64)
    first = sum(lacking[s][0] == low for s in names)
    sums = np.zeros((first, len(names)), np.int64)
    terms = table["term"].filter(pa.array(is_term)).combine_chunks().dictionary_encode()
    number = terms.indices.to_numpy().astype(np.int64)
    place, value = np.array([at[s] for s in source[is_term]], np.int64), p[is_term]
    order = np.argsort(number, kind="stable")
    number, place, value = number[order], place[order], value[order]
    step = max(1, CELLS // max(len(names), 1))
    for begin in range(0, len(terms.dictionary), step):
        rows = slice(*np.searchsorted(number, [begin, begin + step]))
        shares = np.tile(base, (min(step, len(terms.dictionary) - begin), 1))
        shares[number[rows] - begin, place[rows]] = value[rows]
        for i in range(first):
            sums[i] += np.abs(shares - shares[:, i : i + 1]).sum(axis=0)
    pairs = [(a, b) for a in range(first) for b in range(a + 1 if low == high else first, len(names))]
    return pa.table(
        {
            "lang": pa.array([lang] * len(pairs), pa.string()),
            "a": pa.array([names[a] for a, _ in pairs], pa.string()),
            "b": pa.array([names[b] for _, b in pairs], pa.string()),
            "value": pa.array([int(sums[a, b]) for a, b in pairs], pa.int64()),
        }
    )


def audit_sources(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    smoothing: int = SMOOTHING,
    scale: int = SCALE,
    top_terms: int = TOP_TERMS,
) -> DataFrame:
    """lang, source, part, item, value (long) and rank (int, from 1 for each lang, source and part).

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lowered. A language keeps the terms in at
    least `min_docs` of its documents (rows). Each of its sources, and the language as a whole, gives a kept term the
    smoothed share of `share`. Part `pair`: the other sources of the language, value the sum over all kept terms of the
    absolute difference of their shares (0 where nothing is kept), largest first. Part `term`: the terms whose share in
    the source exceeds that in the language, value the excess, the `top_terms` largest. Ties go by the item's bytes.

    Terms are counted in each slice of text, then in each task, then by key, so that neither a hot source nor a frequent
    term gathers rows. Pairs are compared in blocks of terms and tiles of sources, all terms of a block at once, so neither a
    language nor a source is one task's, and no row leaves for a pair and a term. A slice's memory follows the
    longest text. Nulls in any column count as ''; a text without terms still makes its group; an empty
    table gives no rows; a repeated row is a document again; other columns play no part.
    """
    clean = docs.select(
        *(F.coalesce(docs[name].cast("string"), F.lit("")).alias(own) for name, own in ((lang, "lang"), (source, "source"), (text, "text")))
    )
    every = Window.partitionBy("lang", "term")
    kept = cut_lineage(
        count_terms(clean)
        .select("lang", "source", "term", "n", F.sum("docs").over(every).alias("docs"), F.sum("n").over(every).alias("n_lang"))
        .where(F.col("docs") >= min_docs)
        .drop("docs")
    )
    terms = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n"), F.count("*").alias("rows"))
    whole = terms.groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("n").alias("lang_total"), F.ceil(F.sum("rows") / BLOCK_ROWS).alias("blocks")
    )
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = clean.select("lang", "source").distinct()
    sources = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE_SOURCES).alias("tiles"))
    zero = F.lit(0).cast("long")
    groups = cut_lineage(
        groups.join(totals, ["lang", "source"], "left").join(whole, "lang", "left").join(sources, "lang").select(
            "lang", "source", "tiles", F.expr("pmod(xxhash64(source), tiles)").alias("tile"),
            F.greatest(F.coalesce("blocks", zero), F.lit(1)).alias("blocks"),
            *(F.coalesce(name, zero).alias(name) for name in ("total", "terms", "lang_total")),
        )
    )

    def shared(count: Column, total: str) -> Column:
        return share(count, F.col(total), F.col("terms"), smoothing, scale)

    rated = kept.join(groups, ["lang", "source"]).withColumn("p", shared(F.col("n"), "total"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    excess = F.col("p") - shared(F.col("n_lang"), "lang_total")
    over = rated.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess.alias("value"))
    over = over.where("value > 0").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)

    lacking = shared(zero, "total") if smoothing else F.lit(1).cast("long")
    lacking = F.when(F.col("terms") > 0, lacking).otherwise(zero)
    columns = ["lang", "block", "source", "tile", "tiles", "term", "p"]
    held = rated.withColumn("block", F.expr("pmod(xxhash64(term), blocks)")).select(*columns)
    bases = groups.withColumns(
        {"block": F.explode(F.sequence(zero, F.col("blocks") - 1)), "term": F.lit(None).cast("string"), "p": lacking}
    ).select(*columns)
    dealt = held.unionByName(bases).withColumn("with", F.explode(F.sequence(zero, F.col("tiles") - 1)))
    dealt = dealt.withColumns({"low": F.least("tile", "with"), "high": F.greatest("tile", "with")})
    dealt = dealt.select("lang", "block", "low", "high", "source", "tile", "term", "p")
    sums = (
        dealt.groupBy("lang", "block", "low", "high").applyInArrow(_pair_sums, "lang string, a string, b string, value long")
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    )
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", "value", sides.alias("side")).select(
        "lang", "side.source", F.lit("pair").alias("part"), "side.item", "value"
    )
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(over)
