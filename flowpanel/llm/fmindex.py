"""Suffix arrays, wavelet matrices and FM-indexes over integer sequences (numpy, one shard at a time).

Built inside tasks over bounded shards; every function works on whole arrays.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def dense(values: np.ndarray) -> np.ndarray:
    """Ranks 0.. of the distinct values."""
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def suffix_array(symbols: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling.

    With ``depth`` suffixes are compared over at least so many symbols and ties stay in text order;
    without it the order is total.
    """
    n = len(symbols)
    rank, width = dense(symbols), 1
    order = np.argsort(rank, kind="stable")
    while n and (depth is None or width < depth) and width < n:
        if rank[order[-1]] == n - 1:
            break
        key = rank * (n + 1)
        key[:n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        own = key[order]
        step = np.zeros(n, np.int64)
        step[1:] = own[1:] != own[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        width *= 2
    return order


class WaveletMatrix:
    """Rank queries over a sequence of symbols below ``sigma``: one bit vector for each bit."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n, self.bits = len(seq), max(1, int(sigma - 1).bit_length())
        self.words, self.sums, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(self.n // 64 + 1, U)
            words.view(np.uint8)[:len(packed)] = packed
            sums = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=sums[1:])
            self.words.append(words)
            self.sums.append(sums)
            ones = bit.astype(bool)
            self.zeros.append(self.n - int(sums[-1]))
            seq = np.concatenate([seq[~ones], seq[ones]])
        self.begin = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            word = i >> 6
            below = (U(1) << (i & 63).astype(U)) - U(1)
            ones = self.sums[k][word] + np.bitwise_count(self.words[k][word] & below)
            bit = (c >> (self.bits - 1 - k)) & 1
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[k] among the first i[k] symbols."""
        return self._descend(c, i) - self.begin[c]

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbols at i."""
        c = np.zeros(len(i), np.int64)
        for k in range(self.bits):
            word, at = i >> 6, (i & 63).astype(U)
            bit = ((self.words[k][word] >> at) & U(1)).astype(np.int64)
            ones = self.sums[k][word] + np.bitwise_count(self.words[k][word] & ((U(1) << at) - U(1)))
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
            c = c * 2 + bit
        return c


class FMIndex:
    """Backward search and location over ``symbols`` (0 separates texts; the last one is 0).

    The text itself isn't kept: the wavelet matrix of its BWT, symbol counts, and the suffix
    positions divisible by ``sample``.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, depth: int | None = None, sample: int = 8):
        sa = suffix_array(symbols, depth)
        bwt = symbols[sa - 1]
        self.n = len(symbols)
        self.wm = WaveletMatrix(bwt, sigma)
        counts = np.bincount(symbols, minlength=sigma)
        self.before = np.cumsum(counts) - counts
        if depth is None:
            marked = sa % sample == 0
            self.marked, self.kept = marked, sa[marked]
            self.mark_rank = np.cumsum(marked) - 1
        self.sa = sa if depth is not None else None

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the rows that begin with c before what [lo, hi) begins with."""
        both = self.wm.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        base = self.before[c]
        return base + both[:len(c)], base + both[len(c):]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of right-aligned patterns (a row each, padded on the left)."""
        m, width = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for k in range(width):
            live = np.flatnonzero((k < lengths) & (lo < hi))
            if not len(live):
                break
            lo[live], hi[live] = self.extend(patterns[live, width - 1 - k], lo[live], hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to the nearest sampled position."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.copy()
        while len(live):
            here = self.marked[at]
            hit = live[here]
            out[hit] = self.kept[self.mark_rank[at[here]]] + steps[hit]
            live, at = live[~here], at[~here]
            if len(live):
                c = self.wm.access(at)
                at = self.before[c] + self.wm.rank(c, at)
                steps[live] += 1
        return out
