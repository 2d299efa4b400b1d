"""FM-index over one shard of word numbers: suffix array, BWT in a wavelet matrix, sampled positions.

The text is an array of symbols; 0 ends a segment and matches nothing. Each 0 counts as a symbol of
its own, ordered by place, so every suffix comparison ends at the next 0.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    ends = text == 0
    key = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rows, fresh, depth = np.arange(n), key[order], 1
    while len(rows):
        first = np.empty(len(rows), bool)
        first[0], first[1:] = True, fresh[1:] != fresh[:-1]
        heads = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
        rank[order[rows]] = heads
        tied = ~first
        tied[:-1] |= ~first[1:]
        rows = rows[tied]
        if not len(rows):
            break
        at = order[rows]
        fresh = rank[at] * n + rank[at + depth]
        again = np.argsort(fresh, kind="stable")
        order[rows], fresh = at[again], fresh[again]
        depth *= 2
    return order


class Bits:
    """Bit vector with ranks: packed words and the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (at & 63).astype(np.uint64)
        part = self.words[word] & ((np.uint64(1) << low) - np.uint64(1))
        return self.before[word] + np.bitwise_count(part)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray) -> None:
        self.height = max(1, int(symbols.max(initial=1)).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for shift in range(self.height - 1, -1, -1):
            ones = (symbols >> shift & 1).astype(bool)
            low = symbols[~ones]
            self.levels.append((Bits(ones), len(low)))
            symbols = np.concatenate([low, symbols[ones]])

    def map(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place of prefix ``at`` on the bottom level, on the way that ``symbol`` takes."""
        for (bits, zeros), shift in zip(self.levels, range(self.height - 1, -1, -1), strict=True):
            ones = bits.rank(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at rows, and the rows' places on the bottom level."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
            symbol = symbol << 1 | one
        return symbol, at


class FMIndex:
    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        self.n = len(text)
        order = suffix_array(text)
        self.wavelet = WaveletMatrix(np.where(order > 0, text[order - 1], 0))
        counts = np.bincount(text, minlength=2)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        every = np.arange(len(counts))
        self.base = self.first[:-1] - self.wavelet.map(every, np.zeros(len(counts), np.int64))
        # Sampled: every so many places, and starts of segments, so that no walk has to cross a 0.
        kept = (order % sample == 0) | (text[order - 1] == 0)
        self.sampled, self.places = Bits(kept), order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the rows of ``patterns`` (symbols from 1): ranges [low, high) of suffixes."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        alive = np.flatnonzero((patterns < len(self.base)).all(axis=1))
        high[np.setdiff1d(np.arange(len(patterns)), alive)] = 0
        for column in range(patterns.shape[1] - 1, -1, -1):
            if not len(alive):
                break
            symbol = patterns[alive, column].astype(np.int64)
            low[alive] = self.base[symbol] + self.wavelet.map(symbol, low[alive])
            high[alive] = self.base[symbol] + self.wavelet.map(symbol, high[alive])
            alive = alive[high[alive] > low[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffix rows: walk back to the nearest sampled place."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, open_ = rows.copy(), np.arange(len(rows))
        while len(open_):
            done = self.sampled.get(at[open_])
            hit = open_[done]
            out[hit] = self.places[self.sampled.rank(at[hit])] + steps[hit]
            open_ = open_[~done]
            symbol, bottom = self.wavelet.access(at[open_])
            at[open_] = self.base[symbol] + bottom
            steps[open_] += 1
        return out
