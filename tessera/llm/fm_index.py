"""A compressed FM-index over a sequence of small integers: Burrows-Wheeler transform in a wavelet matrix.

Bits are packed 64 to a word with one running count per word, so an index of n symbols from an alphabet of s takes about
1.5 * n * log2(s) bits. Suffixes are sorted by their first `depth` symbols, which is all that patterns up to that length
need. Searches are vectorised: one backward step moves every pattern of a batch by one symbol.
"""

from __future__ import annotations

import numpy as np


class _Bits:
    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1]
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        at = i >> 6
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class FMIndex:
    """sequence: symbols from 0; 0 separates texts and occurs in no pattern. depth: the longest pattern."""

    def __init__(self, sequence: np.ndarray, depth: int):
        self.sequence, self.depth, self.n = sequence.astype(np.int64), depth, len(sequence)
        self.order = self._sorted_suffixes()
        symbols = int(self.sequence.max()) + 1
        bwt = self.sequence[self.order - 1]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(self.sequence, minlength=symbols))))[:-1]
        self.levels: list[tuple[int, _Bits]] = []
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bits = ((bwt >> shift) & 1).astype(np.uint8)
            self.levels.append((shift, _Bits(bits)))
            bwt = np.concatenate((bwt[bits == 0], bwt[bits == 1]))
        every = np.arange(symbols)
        self.base = self._down(every, np.zeros(symbols, np.int64))

    def _sorted_suffixes(self) -> np.ndarray:
        _, rank = np.unique(self.sequence, return_inverse=True)
        width = 1
        while width < min(self.depth, self.n):  # no two suffixes agree on more symbols than there are
            after = np.zeros(self.n, np.int64)
            after[: self.n - width] = rank[width:] + 1
            _, rank = np.unique(rank * (self.n + 1) + after, return_inverse=True)
            width *= 2
        return np.argsort(rank, kind="stable")

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> shift) & 1, bits.zeros + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with c put in front."""
        both = self._down(np.concatenate((c, c)), np.concatenate((low, high)))
        shift = self.start[c] - self.base[c]
        return both[: len(c)] + shift, both[len(c) :] + shift

    def classes(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place in suffix order: first and past-the-end place with the same length-prefix; the firsts alone."""
        padded = np.concatenate((self.sequence, np.zeros(length, np.int64)))
        same = np.ones(self.n - 1, bool)
        for k in range(length):
            here = padded[self.order + k]
            same &= here[1:] == here[:-1]
        firsts = np.flatnonzero(np.concatenate(([True], ~same)))
        number = np.cumsum(np.concatenate(([True], ~same))) - 1
        return firsts[number], np.append(firsts[1:], self.n)[number], firsts

    def windows(self, texts: list[np.ndarray], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Matching statistics of each text, capped at length: for every start the suffix interval of the window there.

        Texts are read from their ends. A pattern grows to length + 1 by one backward step and is cut back to length by
        going to the interval of its length-prefix (the parent whose common prefix is that long). An absent window has an
        empty interval; then the patterns after it start anew one window long.
        """
        if self.depth <= length:
            raise ValueError("depth must exceed the window length")
        first, past, _ = self.classes(length)
        found = [(np.zeros(max(0, len(t) - length + 1), np.int64), np.zeros(max(0, len(t) - length + 1), np.int64)) for t in texts]
        order = sorted((k for k, t in enumerate(texts) if len(t) >= length), key=lambda k: -len(texts[k]))
        if not order:
            return found
        sizes = np.array([len(texts[k]) for k in order])
        ends = np.cumsum(sizes)
        joined = np.concatenate([texts[k] for k in order])
        known = joined < len(self.start)
        low, high = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64)
        lows, highs = np.zeros(len(joined), np.int64), np.zeros(len(joined), np.int64)
        broken = np.zeros(len(order), bool)
        for step in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -step, side="left"))
            at = ends[:live] - 1 - step
            symbol = np.where(known[at], joined[at], 0)
            low, high = self.extend(symbol, low[:live], high[:live])
            high = np.where(known[at], high, low)
            if step >= length - 1:
                gone = (high <= low) | broken[:live]
                if gone.any():  # a miss hides the windows after it: these are searched on their own
                    again = np.flatnonzero(gone)
                    a, b = self._search(joined, at[again], length, known)
                    low[again], high[again] = a, b
                broken = high <= low
                safe = np.minimum(low, self.n - 1)
                low, high = np.where(broken, low, first[safe]), np.where(broken, high, past[safe])
                lows[at], highs[at] = low, high
            else:
                broken = broken[:live]
        for k, size, end in zip(order, sizes, ends, strict=True):
            span = slice(end - size, end - length + 1)
            found[k] = (lows[span], highs[span])
        return found

    def _search(self, joined: np.ndarray, at: np.ndarray, length: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        for k in range(length - 1, -1, -1):
            ok = known[at + k]
            low, high = self.extend(np.where(ok, joined[at + k], 0), low, high)
            high = np.where(ok, high, low)
        return low, high
