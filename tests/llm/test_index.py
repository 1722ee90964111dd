"""The FM-index on foreign texts against plain search, and the hash of contents."""

import numpy as np
import pytest

from barloom.llm.fm_index import FMIndex
from barloom.llm.winnow import content_hashes


def _index(parts, sigma, window):
    return FMIndex([np.array(p) for p in parts], np.arange(len(parts)), sigma, window)


def _plain(parts, text, window):
    """(length, least part of the window) at each position of text."""
    have = [{tuple(p[i : i + n]) for p in parts for i in range(len(p) - n + 1)} for n in range(window + 1)]
    out = []
    for i in range(len(text)):
        n = max(n for n in range(min(window, len(text) - i) + 1) if tuple(text[i : i + n]) in have[n] or n == 0)
        w = tuple(text[i : i + window])
        owners = [k for k, p in enumerate(parts) if any(tuple(p[j : j + window]) == w for j in range(len(p) - window + 1))]
        out.append((n, min(owners) if n == window else None))
    return out


@pytest.mark.parametrize(("sigma", "window", "seed"), [(3, 4, 1), (3, 7, 2), (5, 3, 3), (2, 8, 4), (9, 2, 5), (4, 1, 6)])
def test_statistics_of_foreign_texts(sigma, window, seed):
    r = np.random.default_rng(seed)
    parts = [r.integers(1, sigma, r.integers(1, 40)).tolist() for _ in range(6)]
    texts = [r.integers(0, sigma + 2, r.integers(0, 50)).tolist() for _ in range(8)] + [parts[0], parts[1] + parts[2]]
    texts = [[x if 0 < x < sigma else sigma for x in t] for t in texts]
    index = _index(parts, sigma, window)
    for text, (lengths, classes) in zip(texts, index.matching_statistics([np.array(t, np.int64) for t in texts]), strict=True):
        got = [(int(n), int(index.class_least[c]) if c >= 0 else None) for n, c in zip(lengths, classes, strict=True)]
        assert got == _plain(parts, text, window)


def test_match_is_shortened_not_dropped():
    a, c = list(range(1, 61)), list(range(61, 81))
    index = _index([a, a[30:] + c], 81, 50)
    assert (index.matching_classes([np.array(a + c)])[0] >= 0).sum() == 12


def test_regular_contents_stay_apart():
    n = 4096
    bit = np.array([bin(i).count("1") & 1 for i in range(n)])
    one, two = np.where(bit, 7, 12).astype(np.uint64), np.where(bit, 12, 7).astype(np.uint64)
    both = np.concatenate((one, two, one))
    h = content_hashes(both, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert h[0] == h[2] != h[1]
