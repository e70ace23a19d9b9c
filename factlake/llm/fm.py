"""A compressed FM-index over words: a wavelet matrix of the Burrows-Wheeler transform, searched
backward for matching statistics up to a fixed length."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with ranks: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low).astype(np.int64)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        current = symbols
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (current >> shift) & 1
            self.levels.append((shift, Bits(bit.astype(bool)), int(len(bit) - bit.sum())))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        self.first = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._down(symbol, i) - self.first[symbol]


#: Searches begin with so many words at once, from a table of what the index holds.
TABLE = 8
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _gram(symbols: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` symbols from each position on."""
    h = np.zeros(len(at), np.uint64)
    for d in range(length):
        h = (h ^ symbols[at + d].astype(np.uint64)) * _MIX[0]
        h = (h ^ (h >> np.uint64(32))) * _MIX[1]
    return h


class FmIndex:
    """Over several word sequences; finds the longest match of up to ``depth`` words.

    Suffixes are sorted by their first words only, as many as a search can compare. The suffix
    array isn't kept: what stays is the wavelet matrix, a byte for each suffix, the words it
    shares with the one before, from which parent intervals come, and for each interval of
    ``depth`` words the least of the ``ids`` of its sequences.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, depth: int, ids: np.ndarray | None = None) -> None:
        self.depth = depth
        self.alphabet, symbols = np.unique(words, return_inverse=True)
        n = len(words) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = symbols + 1  # 0 ends a sequence
        # ranks by the first h words; as many neighbours' ranks as fit into 63 bits give the next
        key, h = text, 1
        while True:
            bits = max(1, int(key.max(initial=0)).bit_length())
            take = min(63 // bits, -(-depth // h))
            wide = np.zeros(n, np.int64)
            for k in range(take):
                wide <<= bits
                wide[: max(0, n - k * h)] |= key[k * h :]
            h *= take
            suffixes = np.argsort(wide)
            if h >= depth:
                break
            ordered = wide[suffixes]
            key = np.empty(n, np.int64)
            key[suffixes] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        self.table = min(TABLE, depth - 1)
        same = np.ones(max(0, n - 1), bool)
        self.common = np.zeros(n, np.int8)
        padded = np.concatenate([text, np.zeros(depth, np.int64)])
        for d in range(depth):
            x = padded[suffixes + d]
            same &= x[1:] == x[:-1]
            self.common[1:] += same
        sigma = len(self.alphabet) + 1
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.tree = WaveletMatrix(text[suffixes - 1], sigma)
        self.n = n
        self.begins: dict[int, np.ndarray] = {}
        if ids is not None:
            self.ids = np.minimum.reduceat(np.repeat(ids, lengths + 1)[suffixes], self.begin(depth))
        begin = np.flatnonzero(self.common < self.table)
        grams = _gram(padded, suffixes[begin], self.table)
        order = np.argsort(grams)
        self.grams, self.gram_begin = grams[order], begin[order]
        self.gram_end = np.append(begin[1:], n)[order]

    def begin(self, length: int) -> np.ndarray:
        """Where the intervals of suffixes that share their first ``length`` words begin."""
        if length not in self.begins:
            self.begins[length] = np.flatnonzero(self.common < length).astype(np.int32) if length else np.zeros(1, np.int32)
        return self.begins[length]

    def least(self, suffix: np.ndarray) -> np.ndarray:
        """The least id in the interval of ``depth`` words of each suffix."""
        return self.ids[np.searchsorted(self.begin(self.depth), suffix, side="right") - 1]

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Ids of words, -1 for those that aren't here."""
        at = np.searchsorted(self.alphabet, words)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == words, at + 1, -1) if len(self.alphabet) else np.full(len(words), -1)

    def matching_statistics(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word of the streamed sequences: the length of the longest match that begins
        there (``depth`` at most) and the first suffix of its interval.

        All sequences go backward side by side. A match that can't be extended to the left is
        first cut on the right, to its parent interval, word by word. A sequence whose last
        words are in the table starts before them; those then match up to its end, and have no
        interval (-1).
        """
        symbol = self.symbols(words)
        found, where = np.zeros(len(words), np.int8), np.zeros(len(words), np.int64)
        ends = np.cumsum(lengths)
        order = np.argsort(-lengths, kind="stable")
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        size = np.zeros(len(lengths), np.int64)
        sorted_lengths = -lengths[order]
        skip = np.zeros(len(lengths), bool)
        able = np.flatnonzero(lengths >= self.table) if self.table else np.zeros(0, np.int64)
        if len(able):
            grams = _gram(symbol, ends[able] - self.table, self.table)
            at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            hit = self.grams[at] == grams
            able, at = able[hit], at[hit]
            skip[able], low[able], high[able], size[able] = True, self.gram_begin[at], self.gram_end[at], self.table
            for d in range(self.table):
                found[ends[able] - 1 - d], where[ends[able] - 1 - d] = d + 1, -1
        for step in range(int(lengths.max(initial=0))):
            lanes = order[: np.searchsorted(sorted_lengths, -step, side="left")]
            if step < self.table:
                lanes = lanes[~skip[lanes]]
            at = ends[lanes] - 1 - step
            size[lanes] = np.where(symbol[at] < 0, 0, size[lanes])
            self._cut(lanes[size[lanes] == self.depth], low, high, size)
            todo = lanes[symbol[at] >= 0]
            low[lanes[symbol[at] < 0]], high[lanes[symbol[at] < 0]] = 0, self.n
            while len(todo):
                c = symbol[ends[todo] - 1 - step]
                a = self.less[c] + self.tree.rank(c, low[todo])
                b = self.less[c] + self.tree.rank(c, high[todo])
                good = a < b
                low[todo[good]], high[todo[good]] = a[good], b[good]
                size[todo[good]] += 1
                todo = todo[~good]
                self._cut(todo, low, high, size)
            found[at], where[at] = size[lanes], low[lanes]
        return found, where

    def _cut(self, lanes: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> None:
        size[lanes] -= 1
        for length in np.unique(size[lanes]):
            those = lanes[size[lanes] == length]
            begin = self.begin(int(length))
            at = np.searchsorted(begin, low[those], side="right")
            low[those], high[those] = begin[at - 1], np.append(begin, self.n)[at]
