"""A compressed FM-index over word sequences, in numpy: wavelet matrix, backward search, matching statistics."""

from __future__ import annotations

from functools import cached_property

import numpy as np


class Bits:
    """A bit vector with constant-time rank: 64 bits a word and a count before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.total = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Symbols level by level from the highest bit, zeros before ones on each level."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels, self.zeros = [], []
        self.depth = max(1, int(sigma - 1).bit_length())
        for level in range(self.depth - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def map(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the prefix of length i ends among the occurrences of the symbol, on the last level."""
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(i)
            i = np.where((symbol >> (self.depth - 1 - k)) & 1 == 1, zeros + ones, i - ones)
        return i


def suffix_order(text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, how many of its first `window` symbols each shares with the one before).

    text: ranks in which every end mark is unique. Prefix doubling; what is shared is put together from the ranks of
    power-of-two lengths.
    """
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    parts, size = {}, 1
    order = np.argsort(rank, kind="stable")
    while True:
        if size <= window:
            parts[size] = rank
        if size * 2 > window and rank.max(initial=0) == n - 1:
            break
        second = np.zeros(n, np.int64)
        second[: max(0, n - size)] = rank[size:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
        size *= 2
    shared = np.zeros(n, np.int64)
    for size in sorted(parts, reverse=True):
        left, right = order[:-1] + shared[1:], order[1:] + shared[1:]
        inside = np.maximum(left, right) < n
        r = parts[size]
        shared[1:] += size * (inside & (r[np.minimum(left, n - 1)] == r[np.minimum(right, n - 1)]))
    return order, np.minimum(shared, window)


class FMIndex:
    """Index of word sequences; equal windows of `window` words form a class that holds the least owner."""

    def __init__(self, parts: list[np.ndarray], owners: np.ndarray, sigma: int, window: int) -> None:
        """parts: symbols from 1 below sigma; owners: a rank for each part."""
        k = len(parts)
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = np.concatenate(parts)
        ranked = text + (k - 1)
        ranked[ends] = np.arange(k)
        order, shared = suffix_order(ranked, window)
        same = shared == window
        same[:1] = False
        self.window, self.n = window, len(text)
        self.bwt = WaveletMatrix(np.where(order > 0, text[order - 1], 0), sigma)
        counts = np.bincount(text, minlength=sigma)
        symbols = np.arange(sigma)
        self.shift = np.cumsum(counts) - counts - self.bwt.map(symbols, np.zeros(sigma, np.int64))
        begin = np.flatnonzero(~same)
        self.class_bits = Bits(~same)
        self.class_begin = np.append(begin, self.n)
        owner = np.repeat(owners, sizes + 1)
        self.class_least = np.minimum.reduceat(owner[order], begin)
        self.sigma = sigma
        self.shared = np.concatenate(([-1], shared[1:], [-1])).astype(np.int16)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the rows whose suffixes start with symbol and then match as before."""
        both = self.bwt.map(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return self.shift[symbol] + both[: len(low)], self.shift[symbol] + both[len(low) :]

    @cached_property
    def _nearest_less(self) -> tuple[np.ndarray, np.ndarray]:
        """For each boundary between rows the nearest before and behind it where fewer symbols are shared."""
        n = len(self.shared)
        at = np.arange(n, dtype=np.int32)
        before, behind = np.zeros(n, np.int32), np.full(n, n - 1, np.int32)
        for value in np.unique(self.shared)[1:]:
            own, less = np.flatnonzero(self.shared == value), self.shared < value
            before[own] = np.maximum.accumulate(np.where(less, at, 0))[own]
            behind[own] = np.minimum.accumulate(np.where(less, at, n - 1)[::-1])[::-1][own]
        return before, behind

    def shorten(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, rows, length) of the longest shorter beginning of a match that more rows have: symbols leave at its right end."""
        before, behind = self._nearest_less
        length = np.maximum(self.shared[low], self.shared[high])
        return np.where(self.shared[low] < length, low, before[low]), np.where(self.shared[high] < length, high, behind[high]), np.maximum(length, 0)

    def matching_statistics(self, parts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each position of each streamed part (length, class): the symbols from there that the index holds in a row, at
        most `window`, and the class of the window if it is whole, else -1.

        Backward search from the right end of all parts at once. A match longer than the window is widened to the
        interval of its first `window` symbols; where no row extends a match, it is shortened from the right until one does.
        Symbols outside 1 to sigma - 1 are in no index.
        """
        sizes = np.array([len(p) for p in parts])
        by_size = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max(initial=0))
        grid = np.zeros((longest, len(parts)), np.int64)
        for lane, i in enumerate(by_size):
            grid[: sizes[i], lane] = parts[i][::-1]
        grid[(grid < 1) | (grid >= self.sigma)] = 0
        classes = np.full((longest, len(parts)), -1, np.int64)
        lengths = np.zeros((longest, len(parts)), np.int16)
        low = np.zeros(len(parts), np.int64)
        high = np.full(len(parts), self.n, np.int64)
        depth = np.zeros(len(parts), np.int64)
        live_at = np.searchsorted(-sizes[by_size], -np.arange(longest), "left")
        for step in range(longest):
            m = int(live_at[step])
            symbol, from_low, from_high, d = grid[step, :m], low[:m], high[:m], depth[:m]
            lo, hi = self.extend(symbol, from_low, from_high)
            hi[symbol == 0] = lo[symbol == 0]
            known = np.flatnonzero((hi <= lo) & (symbol != 0) & (d > 0))
            while len(known):
                from_low[known], from_high[known], d[known] = self.shorten(from_low[known], from_high[known])
                lo[known], hi[known] = self.extend(symbol[known], from_low[known], from_high[known])
                known = known[(hi[known] <= lo[known]) & (d[known] > 0)]
            lost = hi <= lo
            d = np.where(lost, 0, d + 1)
            lo, hi = np.where(lost, 0, lo), np.where(lost, self.n, hi)
            full = np.flatnonzero(d >= self.window)
            if len(full):
                c = self.class_bits.rank(lo[full] + 1) - 1
                classes[step, full] = c
                lo[full], hi[full] = self.class_begin[c], self.class_begin[c + 1]
                d[full] = self.window
            lengths[step, :m] = d
            low[:m], high[:m], depth[:m] = lo, hi, d
        empty = (np.empty(0, np.int16), np.empty(0, np.int64))
        out: list[tuple[np.ndarray, np.ndarray]] = [empty] * len(parts)
        for lane, i in enumerate(by_size):
            out[i] = lengths[: sizes[i], lane][::-1], classes[: sizes[i], lane][::-1]
        return out

    def matching_classes(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of each streamed part the class it matches, -1 if the index lacks it."""
        found = self.matching_statistics(parts)
        return [classes[: max(0, len(part) - self.window + 1)] for part, (_, classes) in zip(parts, found, strict=True)]
