"""A compressed full-text index of a sequence of small integers: suffix order, its last column in a wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of `text` by the suffix that starts there; ranks of doubled prefixes are sorted until all differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank = new
        if rank.max(initial=0) == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Counts of a symbol before a place, one bit of the symbol at a time, highest first."""

    def __init__(self, text: np.ndarray) -> None:
        self.levels = max(1, int(text.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        now = text
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(now) - int(self.ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        lo, hi = np.zeros_like(place), place
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbol >> (self.levels - 1 - i)) & 1).astype(bool)
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo


class FMIndex:
    """Finds all places of phrases in `text`, whose symbols are integers from 0 up."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        closed = np.append(np.asarray(text, dtype=np.int64) + 1, 0)
        order = suffix_order(closed)
        self.last = closed[order - 1]
        self.wavelet = WaveletMatrix(self.last)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(closed))])
        marked = order % sample == 0
        self.marked = marked
        self.nth = np.concatenate([[0], np.cumsum(marked)])
        self.samples = order[marked]
        self.size = len(closed)

    def ranges(self, phrases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase the range of suffixes that begin with it, by backward search of all phrases at once."""
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.size, dtype=np.int64)
        lengths = np.array([len(p) for p in phrases], dtype=np.int64)
        if not len(phrases):
            return lo, hi
        flat = np.concatenate(phrases).astype(np.int64) + 1
        ends = np.cumsum(lengths)
        known = len(self.before) - 1
        for back in range(1, int(lengths.max()) + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(live):
                break
            symbol = flat[ends[live] - back]
            there = symbol < known
            hi[live[~there]] = lo[live[~there]]
            live, symbol = live[there], symbol[there]
            base = self.before[symbol]
            lo[live], hi[live] = base + self.wavelet.rank(symbol, lo[live]), base + self.wavelet.rank(symbol, hi[live])
        return lo, hi

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the given suffixes: step back through the text to the next sampled one."""
        row, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        while True:
            left = np.flatnonzero(~self.marked[row])
            if not len(left):
                return self.samples[self.nth[row]] + steps
            symbol = self.last[row[left]]
            row[left] = self.before[symbol] + self.wavelet.rank(symbol, row[left])
            steps[left] += 1

    def find(self, phrases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences, as the number of the phrase and where it starts."""
        lo, hi = self.ranges(phrases)
        n = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(phrases)), n)
        rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return which, self.places(rows)
