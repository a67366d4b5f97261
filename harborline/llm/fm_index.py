"""FM-index over word sequences: backward search on a wavelet matrix, many patterns at a time."""

from __future__ import annotations

from functools import cached_property

import numpy as np


class Wavelet:
    """A sequence of small integers as one bit vector for each bit, with counts for each 64 places."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            words = np.zeros(len(values) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]]))
            self.zeros.append(int(len(values) - one.sum()))
            values = np.concatenate([values[~one], values[one]])
        every = np.arange(top + 1)
        self.begin = self._descend(every, np.zeros(top + 1, np.int64))

    def _descend(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            word = at >> 6
            below = self.words[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[level][word] + np.bitwise_count(below)
            at = np.where(value >> (self.bits - 1 - level) & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value occurs before its place."""
        return self._descend(value, at) - self.begin[value]


class FMIndex:
    """Index of sequences (64-bit word hashes) that finds, for a pattern's every end, its longest match.

    Matches are followed up to `depth` words. Suffixes are sorted by at least depth + 1 words, which is all that a
    backward search of such patterns looks at; owners are the numbers whose least a full match reports.
    """

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, owners: np.ndarray, depth: int):
        self.depth = depth
        self.alphabet, coded = np.unique(hashes, return_inverse=True)
        places = np.arange(len(hashes)) + np.repeat(np.arange(len(sizes)), sizes)
        n = len(hashes) + len(sizes)
        text = np.zeros(n, np.int64)  # 0 ends each sequence
        text[places] = coded + 1
        self.text, self.size = text, n
        rank = text
        self.ranks = [rank.astype(np.int32)]
        order = np.argsort(rank, kind="stable")
        reach = 1
        while reach <= depth:
            after = np.zeros(n, np.int64)
            after[: max(n - reach, 0)] = rank[reach:] + 1
            key = rank * (n + 2) + after
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
            reach *= 2
            self.ranks.append(rank.astype(np.int32))
        self.order = order
        top = int(text.max(initial=0))
        self.wavelet = Wavelet(text[order - 1], top)  # the word before each suffix; the last one's for the first
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))[:-1]])
        # Suffixes that agree in `depth` words lie together.
        apart = self.common < depth
        self.first = np.maximum.accumulate(np.where(apart, np.arange(n), 0))
        heads = np.flatnonzero(apart)
        size = np.diff(np.append(heads, n))
        self.last = np.repeat(heads + size, size)
        owner = np.full(n, np.iinfo(np.int64).max)
        owner[places] = np.repeat(owners, sizes)
        self.least = np.repeat(np.minimum.reduceat(owner[order], heads), size) if n else owner

    @cached_property
    def common(self) -> np.ndarray:
        """For each suffix in order, how many words it shares with the one before it, up to `depth`."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        shared = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, step = self.ranks[level], 1 << level
            inside = np.maximum(a, b) < self.size
            same = np.zeros(len(a), bool)
            same[inside] = rank[a[inside]] == rank[b[inside]]
            shared += np.where(same, step, 0)
            a, b = a + np.where(same, step, 0), b + np.where(same, step, 0)
        # A shared end mark ends the match.
        left = np.minimum.reduce([shared, self._to_end[self.order[:-1]], self._to_end[self.order[1:]]])
        return np.concatenate([[0], np.minimum(left, self.depth)])[: self.size]

    @cached_property
    def _to_end(self) -> np.ndarray:
        """Words from each place to the end of its sequence."""
        ends = np.flatnonzero(self.text == 0)
        return ends[np.searchsorted(ends, np.arange(self.size))] - np.arange(self.size)

    @cached_property
    def _lows(self) -> list[np.ndarray]:
        """Least of `common` over 1, 2, 4, ... places from each place on."""
        lows = [self.common]
        while 2 << (len(lows) - 1) <= self.size:
            half = 1 << (len(lows) - 1)
            lows.append(np.minimum(lows[-1][:-half], lows[-1][half:]))
        return lows

    def _wider(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval of the longest beginning that more suffixes share, and its length."""
        at_low = self.common[low]
        at_high = np.where(high < self.size, self.common[np.minimum(high, self.size - 1)], 0)
        length = np.maximum(at_low, at_high)
        low, high = low.copy(), high.copy()
        for level in range(len(self._lows) - 1, -1, -1):
            lows, step = self._lows[level], 1 << level
            for _ in range(2):
                can = low - step + 1 >= 0
                can[can] = lows[low[can] - step + 1] >= length[can]
                low[can & (length > 0)] -= step
                low = np.maximum(low, 0)
                can = high + step <= self.size
                can[can] = lows[high[can]] >= length[can]
                high[can & (length > 0)] += step
        none = length == 0
        low[none], high[none] = 0, self.size
        return low, high, length

    def matches(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of a stream of sequences, searched side by side from their ends.

        For each word the length of the longest match that starts there (up to depth), and, where that is
        depth, the least owner of the places it matches.
        """
        total = np.zeros(len(hashes), np.int64)
        owner = np.full(len(hashes), np.iinfo(np.int64).max)
        if not len(hashes) or not self.size:
            return total, owner
        code = np.minimum(np.searchsorted(self.alphabet, hashes), len(self.alphabet) - 1)
        code = np.where(self.alphabet[code] == hashes, code + 1, 0) if len(self.alphabet) else np.zeros(len(hashes), np.int64)
        ends = np.cumsum(sizes)
        order = np.argsort(-sizes, kind="stable")
        ends, sizes = ends[order], sizes[order]
        low = np.zeros(len(sizes), np.int64)
        high = np.full(len(sizes), self.size)
        length = np.zeros(len(sizes), np.int64)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            active = np.arange(np.searchsorted(-sizes, -step, side="right"))
            at = ends[active] - step
            unknown = code[at] == 0
            gone = active[unknown]
            low[gone], high[gone], length[gone] = 0, self.size, 0
            trying = active[~unknown]
            while len(trying):
                value = code[ends[trying] - step]
                both = self.wavelet.rank(np.concatenate([value, value]), np.concatenate([low[trying], high[trying]]))
                new_low = self.below[value] + both[: len(trying)]
                new_high = self.below[value] + both[len(trying) :]
                hit = new_high > new_low
                done = trying[hit]
                low[done], high[done] = new_low[hit], new_high[hit]
                length[done] += 1
                over = done[length[done] > self.depth]
                length[over] = self.depth
                low[over], high[over] = self.first[low[over]], self.last[low[over]]
                trying = trying[~hit]
                if len(trying):
                    low[trying], high[trying], length[trying] = self._wider(low[trying], high[trying])
            total[at] = length[active]
            full = length[active] == self.depth
            owner[at[full]] = self.least[low[active[full]]]
        return total, owner
