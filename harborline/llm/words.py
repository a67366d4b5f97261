"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a longest run of bytes other than blank, tab, line feed, vertical tab, form feed
and carriage return. In UTF-8 these bytes are never part of another character, so the runs
are the same as on code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from harborline.llm.common import offsets

_U = np.uint64


@dataclass
class Words:
    """data: the bytes; starts, ends: of each word; first: index of each text's first word, and the total."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its texts; nulls count as empty."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = offsets(array)
    buffer = array.buffers()[2]
    data = np.zeros(0, np.uint8) if buffer is None else np.frombuffer(buffer, np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def split_words(array: pa.Array, solid_bytes: np.ndarray | None = None) -> Words:
    """The words of each text; solid_bytes (256 booleans) may name other bytes that words are made of."""
    data, at = text_bytes(array)
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(at), np.int64))
    if solid_bytes is None:
        solid_bytes = np.ones(256, bool)
        solid_bytes[[0x20, *range(0x09, 0x0E)]] = False
    solid = solid_bytes[data]
    begins, finishes = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    finishes[:-1] &= ~solid[1:]
    filled = np.flatnonzero(at[1:] > at[:-1])
    begins[at[filled]] = solid[at[filled]]
    finishes[at[filled + 1] - 1] = solid[at[filled + 1] - 1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, at))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hash_words(words: Words, fold_case: bool = False) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, finalised; fold_case lowers A-Z first."""
    if len(words.starts) == 0:
        return np.zeros(0, _U)
    lengths = words.ends - words.starts
    begin = np.concatenate([[0], np.cumsum(lengths)])
    inside = np.arange(begin[-1]) - np.repeat(begin[:-1], lengths)
    codes = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    if fold_case:
        codes[65:91] = codes[97:123]
    powers = np.full(int(lengths.max()), _U(0xD1342543DE82EF95))
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    values = codes[words.data[inside + np.repeat(words.starts, lengths)]] * powers[inside]
    return mix(np.add.reduceat(values, begin[:-1]) + lengths.astype(_U))


def hash_runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` consecutive word hashes; shorter input gives none."""
    if len(hashes) < size:
        return np.zeros(0, _U)
    count = len(hashes) - size + 1
    out = hashes[:count].copy()
    for i in range(1, size):
        out *= _U(0xD1342543DE82EF95)
        out += hashes[i : i + count]
    return mix(out)


def whole_runs(first: np.ndarray, size: int) -> np.ndarray:
    """Which of the runs of `size` words lie inside one text."""
    total = int(first[-1])
    if total < size:
        return np.zeros(0, bool)
    keep = np.zeros(total + 1, np.int64)
    begin, end = first[:-1], np.maximum(first[1:] - size + 1, first[:-1])
    np.add.at(keep, begin, 1)
    np.add.at(keep, end, -1)
    return np.cumsum(keep)[: total - size + 1] > 0
