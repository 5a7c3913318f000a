"""A compressed FM-index over sequences of words, in numpy: backward search on a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with ranks: a count before each 64 of them."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the bits before each place are set."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask).astype(np.int64)


class FMIndex:
    """Over segments of word codes (any 64-bit numbers). Suffixes are sorted by their first 16 words, enough for
    patterns of up to 15: the bounds of such a pattern's interval do not depend on how longer ties are ordered."""

    DEPTH = 15

    def __init__(self, words: np.ndarray, lengths: np.ndarray) -> None:
        self.alphabet, code = np.unique(words, return_inverse=True)
        n = len(words) + len(lengths)
        self.text = np.zeros(n, np.int64)  # 0 parts segments
        self.text[np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)] = code + 1
        self.owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        rank, step = self.text.copy(), 1
        while step < 16:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * (n + len(self.alphabet) + 2) + after
            rank = np.unique(key, return_inverse=True)[1]
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        self.lcp = np.zeros(n, np.uint8)
        same = np.zeros(n, bool)
        same[1:] = True
        for d in range(self.DEPTH):
            w = self.text[np.minimum(self.order + d, n - 1)]
            same[1:] &= (w[1:] == w[:-1]) & (w[1:] > 0)
            self.lcp += same
        bwt = self.text[self.order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=len(self.alphabet) + 1))])
        self.levels, level = [], bwt
        for k in range(int(len(self.alphabet)).bit_length() - 1, -1, -1):
            bit = (level >> k) & 1 == 1
            self.levels.append((k, Bits(bit)))
            level = np.concatenate([level[~bit], level[bit]])
        symbols = np.arange(len(self.alphabet) + 1)
        self.base = self._down(symbols, np.zeros(len(symbols), np.int64))
        self.starts: dict[int, np.ndarray] = {}

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, bits in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> k) & 1 == 1, bits.zeros + ones, at - ones)
        return at

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for those that don't occur."""
        at = np.minimum(np.searchsorted(self.alphabet, words), max(0, len(self.alphabet) - 1))
        return np.where(self.alphabet[at] == words, at + 1, 0) if len(self.alphabet) else np.zeros(len(words), np.int64)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step of each interval [low, high)."""
        shift = self.first[symbol] - self.base[symbol]
        return shift + self._down(symbol, low), shift + self._down(symbol, high)

    def shorten(self, depth: int, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first `depth` words of the suffixes at low."""
        starts = self.group_starts(depth)
        at = np.searchsorted(starts, low, "right") - 1
        return starts[at], np.append(starts, len(self.text))[at + 1]

    def group_starts(self, depth: int) -> np.ndarray:
        if depth not in self.starts:
            self.starts[depth] = np.flatnonzero(self.lcp < depth) if depth else np.zeros(1, np.int64)
        return self.starts[depth]

    def matching_statistics(self, words: np.ndarray, lengths: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
        """For each position of streamed sequences: the length of the longest match that starts there, up to cap (at most
        DEPTH), and the lower bound of its interval. All streams step together, from their ends."""
        ends = np.cumsum(lengths)
        begins, symbols = ends - lengths, self.codes(words)
        found, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at, low, high, size = ends - 1, np.zeros(len(ends), np.int64), np.full(len(ends), len(self.text), np.int64), np.zeros(len(ends), np.int64)
        live = np.flatnonzero(at >= begins)
        while len(live):
            full = live[size[live] == cap]
            if len(full):
                low[full], high[full] = self.shorten(cap - 1, low[full])
                size[full] = cap - 1
            symbol = symbols[at[live]]
            a, b = self.extend(symbol, low[live], high[live])
            good = (a < b) & (symbol > 0)
            on, off = live[good], live[~good]
            low[on], high[on] = a[good], b[good]
            size[on] += 1
            found[at[on]], place[at[on]] = size[on], low[on]
            at[on] -= 1
            none = off[size[off] == 0]
            at[none] -= 1  # the word doesn't occur
            rest = off[size[off] > 0]
            for d in np.unique(size[rest]).tolist():  # drop the last word and try again
                own = rest[size[rest] == d]
                low[own], high[own] = self.shorten(d - 1, low[own])
                size[own] = d - 1
            live = live[at[live] >= begins[live]]
        return found, place
