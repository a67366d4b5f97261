"""The index against plain search."""

import numpy as np
import pytest

from harborline.llm.fm_index import FMIndex, Wavelet


def test_wavelet_ranks():
    rng = np.random.default_rng(0)
    for top, n in ((0, 5), (1, 70), (9, 500), (300, 1000)):
        values = rng.integers(0, top + 1, n)
        tree = Wavelet(values, top)
        value, at = rng.integers(0, top + 1, 200), rng.integers(0, n + 1, 200)
        assert tree.rank(value, at).tolist() == [int((values[:a] == v).sum()) for v, a in zip(value, at)]


@pytest.mark.parametrize("depth", [1, 3, 4, 7, 8, 50])
@pytest.mark.parametrize("letters", [1, 2, 5, 40])
def test_matching_statistics(depth, letters):
    rng = np.random.default_rng(depth * 100 + letters)
    texts = [rng.integers(0, letters, rng.integers(1, 90)) for _ in range(12)]
    texts += [t.copy() for t in texts[:3]]
    owners = rng.integers(0, 50, len(texts))
    index = FMIndex(np.concatenate(texts).astype(np.uint64), np.array([len(t) for t in texts]), owners, depth)
    patterns = texts[:4] + [rng.integers(0, letters + 1, rng.integers(1, 90)) for _ in range(8)]
    patterns.append(np.concatenate([texts[0], texts[5], texts[1]]))
    got, least = index.matches(np.concatenate(patterns).astype(np.uint64), np.array([len(p) for p in patterns]))
    at = 0
    for p in patterns:
        for i in range(len(p)):
            want, own = 0, np.iinfo(np.int64).max
            for t, o in zip(texts, owners):
                for j in range(len(t)):
                    k = 0
                    while k < depth and i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k]:
                        k += 1
                    want = max(want, k)
                    own = min(own, o) if k == depth else own
            assert got[at] == want
            assert want < depth or least[at] == own
            at += 1
