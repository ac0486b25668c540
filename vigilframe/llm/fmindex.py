"""A word FM-index: suffix array, Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions. Every step works on whole arrays."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start places of the sorted suffixes, by doubling the sorted prefix. ``text`` ends in a symbol smaller than all others."""
    n = len(text)
    rank = text.astype(np.int64)
    step = 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if fresh[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = fresh, 2 * step


class Bits:
    """A bit vector that counts its ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        low = self.words[word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def at(self, place: np.ndarray) -> np.ndarray:
        return ((self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(bits - 1, -1, -1):
            ones = ((symbols >> bit) & 1).astype(bool)
            self.levels.append((bit, Bits(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(place)
        for bit, ones, zeros in self.levels:
            up = ((symbol >> bit) & 1).astype(bool)
            a, b = ones.ones(start), ones.ones(place)
            start, place = np.where(up, zeros + a, start - a), np.where(up, zeros + b, place - b)
        return place - start

    def access(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(place)
        for bit, ones, zeros in self.levels:
            up, before = ones.at(place), ones.ones(place)
            symbol |= up.astype(np.int64) << bit
            place = np.where(up, zeros + before, place - before)
        return symbol


class FMIndex:
    """Index over symbols >= 1; ``separator`` symbols are ordinary ones that no phrase holds."""

    def __init__(self, symbols: np.ndarray, sample: int = 8):
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        order = suffix_array(text)
        last = text[order - 1]
        top = int(text.max())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.matrix = WaveletMatrix(last, max(1, top.bit_length()))
        kept = order % sample == 0
        self.kept, self.samples, self.size, self.top = Bits(kept), order[kept], len(text), top

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all phrases at once. Rows of ``phrases`` are right-aligned; the search goes from the last symbol to the first."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        width = phrases.shape[1]
        for step in range(width):
            active = np.flatnonzero((lengths > step) & (low < high))
            symbol = phrases[active, width - 1 - step].astype(np.int64)
            fits = symbol <= self.top
            low[active[~fits]] = high[active[~fits]] = 0
            active, symbol = active[fits], symbol[fits]
            low[active] = self.before[symbol] + self.matrix.rank(symbol, low[active])
            high[active] = self.before[symbol] + self.matrix.rank(symbol, high[active])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows: walk back to the nearest sampled suffix."""
        rows, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.kept.at(rows))
        while len(todo):
            symbol = self.matrix.access(rows[todo])
            rows[todo] = self.before[symbol] + self.matrix.rank(symbol, rows[todo])
            steps[todo] += 1
            todo = todo[~self.kept.at(rows[todo])]
        return self.samples[self.kept.ones(rows)] + steps
