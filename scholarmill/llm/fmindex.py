"""FM-index over word sequences, in numpy: suffix array, Burrows-Wheeler transform, wavelet matrix, sampled positions."""

import numpy as np


class Bits:
    """A bit vector with rank in constant time: 64-bit words and a count before each."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position of ``i``."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Rank and access of symbols below 2 ** levels."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels: list[tuple[Bits, int]] = []
        seq = seq.astype(np.int32)
        for k in range(levels - 1, -1, -1):
            bit = (seq >> k & 1).astype(bool)
            self.levels.append((Bits(bit), int(len(seq) - bit.sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        low, i = np.zeros_like(i), i.copy()
        top = len(self.levels) - 1
        for k, (bits, zeros) in enumerate(self.levels):
            one = (symbol >> (top - k) & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return i - low

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before."""
        low, i = np.zeros_like(i), i.copy()
        symbol = np.zeros_like(i)
        for bits, zeros in self.levels:
            one = bits.get(i).astype(bool)
            a, b = bits.rank(low), bits.rank(i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
            symbol = symbol << 1 | one
        return symbol, i - low


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes of ``seq`` in order: sorted by as many symbols as fit into a number, then those that tie by twice as many, and so on."""
    n = len(seq)
    bits = max(1, int(seq.max()).bit_length())
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key[: max(0, n - k)] |= seq[k:]
    order = np.argsort(key)
    sorted_, place = key[order], np.arange(n)
    rank = np.empty(n, np.int64)
    while True:  # ``place``: where those that are being sorted stand; a rank is the place of the first that ties
        first = np.diff(sorted_, prepend=-1) != 0
        group = np.flatnonzero(first)
        size = np.diff(group, append=len(place))
        rank[order[place]] = np.repeat(place[group], size)
        place = place[np.repeat(size > 1, size)]
        if not len(place):
            return order
        some = order[place]
        after = some + step
        key = rank[some] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        order[place], sorted_ = some[by], key[by]
        step *= 2


class FMIndex:
    """Counts and locates phrases in a sequence of symbols from 1 on."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 4):
        seq = np.append(seq, 0)  # the end, less than all symbols
        sa = suffix_array(seq)
        self.n = len(seq)
        self.bwt = WaveletMatrix(seq[sa - 1], max(1, int(sigma).bit_length()))
        self.first = np.zeros(sigma + 2, np.int64)
        np.cumsum(np.bincount(seq, minlength=sigma + 1), out=self.first[1:])
        marked = sa % sample == 0
        self.marked, self.at = Bits(marked), sa[marked].astype(np.int32)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each row of ``phrases``, by backward search."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k].astype(np.int64)
            low, high = self.first[c] + self.bwt.rank(c, low), self.first[c] + self.bwt.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes at ``rows``, by walking back to sampled ones."""
        out = np.zeros(len(rows), np.int64)
        todo, rows, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            hit = self.marked.get(rows).astype(bool)
            out[todo[hit]] = self.at[self.marked.rank(rows[hit])] + steps
            todo, rows = todo[~hit], rows[~hit]
            symbol, before = self.bwt.access(rows)
            rows = self.first[symbol] + before
            steps += 1
        return out
