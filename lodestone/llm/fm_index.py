"""Compressed FM-index of integer sequences, in NumPy.

The Burrows-Wheeler transform is kept in a wavelet matrix (the wavelet tree's levels, one bit vector each): packed bits
with a running count for every 64 of them, so about 1.5 bits for a symbol and level. Suffixes are sorted by their first
ORDER symbols only, by doubling; backward search is right for patterns up to that length. All searches are vectorised:
many patterns take a step together.
"""

from __future__ import annotations

import numpy as np

ORDER = 64
ONE, LOW6 = np.uint64(1), np.int64(63)


class BitVector:
    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded.reshape(-1, 8), axis=1, bitorder="little").reshape(-1).view("<u8").astype(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int32)
        self.zeros = n - int(counts.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((ONE << (i & LOW6).astype(np.uint64)) - ONE))


class FMIndex:
    """text: symbols from 1, with 0 as a separator after each sequence. weights: how often each place counts (1 if not given)."""

    def __init__(self, text: np.ndarray, weights: np.ndarray | None = None):
        n = len(text)
        self.n = n
        rank = text.astype(np.int64)
        step, ahead = 1, None
        while step < ORDER and n:
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:] + 1 if step < n else 0
            values, rank = np.unique(rank * (int(rank.max()) + 3) + ahead, return_inverse=True)
            step *= 2
            if len(values) == n:
                break
        del ahead
        order = np.argsort(rank, kind="stable")
        del rank
        self.total = np.arange(n + 1) if weights is None else np.concatenate(([0], np.cumsum(weights[order], dtype=np.int64)))
        symbols = text[order - 1].astype(np.int32)
        del order
        self.sigma = int(text.max(initial=0)) + 1
        counts = np.bincount(text, minlength=self.sigma)
        self.levels: list[tuple[int, BitVector]] = []
        for shift in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(np.uint8)
            self.levels.append((shift, BitVector(bits)))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        all_symbols = np.arange(self.sigma, dtype=np.int64)
        self.offset = starts - self._down(all_symbols, np.zeros(self.sigma, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.rank(at)
            at = np.where(symbols >> shift & 1, bits.zeros + ones, at - ones)
        return at

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from the intervals of patterns."""
        both = self._down(np.concatenate((symbols, symbols)), np.concatenate((low, high)))
        off, k = self.offset[symbols], len(symbols)
        return both[:k] + off, both[k:] + off

    def shared_from(self, text: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Backward searches of text[first..last] until places of a weight under two are left.

        Returns the position at which each search stopped, or first - 1 where the whole pattern is found twice or more:
        text[result + 1..last] is the longest suffix that occurs twice.
        """
        stop = first - 1
        alive = np.arange(len(first))
        low, high = np.zeros(len(first), np.int64), np.full(len(first), self.n, np.int64)
        at = last.copy()
        while len(alive):
            low, high = self.extend(text[at].astype(np.int64), low, high)
            ok = self.total[high] - self.total[low] >= 2
            stop[alive[~ok]] = at[~ok]
            go = ok & (at > first[alive])
            alive, low, high, at = alive[go], low[go], high[go], at[go] - 1
        return stop


def repeated_windows(text: np.ndarray, starts: np.ndarray, windows: np.ndarray, width: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Windows of `width` symbols that occur twice or more in all sequences.

    Sequence p has `windows[p]` windows from text[starts[p]], up to the next separator, and stands for `counts[p]` equal ones
    (1 if not given). Returns (sequence, window), both ascending. From matching
    statistics: a window is tested by one backward search; where it stops at j, all windows that hold [j..end] are
    passed over. Where it is found, twice as many windows are tested by the next search.
    """
    counts = np.ones(len(starts), np.int64) if counts is None else counts
    index = FMIndex(text, np.repeat(counts, np.diff(np.append(starts, len(text)))) if len(starts) and starts[0] == 0 else None)
    longest = ORDER - width + 1
    found_p, found_from, found_to = [], [], []
    p = np.arange(len(starts))
    # Sequences that count twice are likely to be found whole.
    at, many = np.zeros(len(starts), np.int64), np.where(counts > 1, np.minimum(windows, longest), 1)
    while len(p):
        first = starts[p] + at
        last = first + many + width - 2
        stop = index.shared_from(text, first, last)
        whole = stop < first
        if whole.any():
            found_p.append(p[whole])
            found_from.append(at[whole])
            found_to.append(at[whole] + many[whole])
        # A single window that isn't repeated: go on behind the place where the search stopped.
        single = ~whole & (many == 1)
        at = np.where(whole, at + many, np.where(single, stop - starts[p] + 1, at))
        many = np.where(whole, many * 2, np.where(single, 1, np.maximum(many // 2, 1)))
        many = np.minimum(many, np.minimum(longest, windows[p] - at))
        go = at < windows[p]
        p, at, many = p[go], at[go], np.maximum(many[go], 1)
    if not found_p:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fp, ff, ft = np.concatenate(found_p), np.concatenate(found_from), np.concatenate(found_to)
    n = ft - ff
    seq = np.repeat(fp, n)
    win = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ff, n)
    o = np.lexsort((win, seq))
    return seq[o], win[o]
