"""An FM-index over symbols: suffix order, wavelet matrix ranks, sampled suffix positions. All steps
work on many patterns or rows at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """Bits with the count of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


class Wavelet:
    """Ranks and symbols of a sequence, one bit vector for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for level in range(self.depth - 1, -1, -1):
            ones = (seq >> level & 1).astype(bool)
            self.levels.append((Bits(ones), int(len(seq) - ones.sum())))
            seq = np.concatenate([seq[~ones], seq[ones]])
        self.first = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            ones = bits.rank(at)
            at = np.where(symbols >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._descend(symbols, at) - self.first[symbols]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols = np.zeros(len(at), np.int64)
        for bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbols = symbols << 1 | one
            at = np.where(one, zeros + ones, at - ones)
        return symbols, at - self.first[symbols]


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes, by prefix doubling; each 0 ends suffixes and is below the next 0."""
    n = len(seq)
    ends = seq == 0
    rank = seq.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(ends.sum())
    width = 1
    while True:
        key = rank * (n + int(ends.sum()) + int(seq.max(initial=0)) + 2)
        key[:-width or None] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class FmIndex:
    """Over seq: runs of symbols 1..sigma-1, each ended by 0; seq starts and ends with 0."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 16):
        seq = np.asarray(seq, np.int64)
        order = suffix_order(seq)
        self.n = len(seq)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.wavelet = Wavelet(seq[order - 1], sigma)
        # Sampled: every so many places, and each run's first, so that no step back leaves a run.
        sampled = np.arange(self.n) % sample == 0
        sampled |= seq == 0
        sampled[1:] |= seq[:-1] == 0
        rows = sampled[order]
        self.sampled, self.places = Bits(rows), order[rows]

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows lo <= row < hi whose suffixes start with each pattern (aligned to the right in its row), by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(1, patterns.shape[1] + 1):
            on = np.flatnonzero((lo < hi) & (lengths >= step))
            if not len(on):
                break
            symbols = patterns[on, -step]
            lo[on] = self.before[symbols] + self.wavelet.rank(symbols, lo[on])
            hi[on] = self.before[symbols] + self.wavelet.rank(symbols, hi[on])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Each row's place: steps back to a sampled suffix, and as many forward."""
        places, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            at = rows[todo]
            known = self.sampled.get(at)
            own = todo[known]
            places[own] = self.places[self.sampled.rank(at[known])] + steps[own]
            todo, at = todo[~known], at[~known]
            symbols, ranks = self.wavelet.symbol_and_rank(at)
            rows = rows.copy() if not rows.flags.writeable else rows
            rows[todo] = self.before[symbols] + ranks
            steps[todo] += 1
        return places
