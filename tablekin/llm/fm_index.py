"""FM-index over a shard of numbered words: suffix order, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

#: Most symbols of a shard: two ranks and a position fit one 64-bit sort key.
MOST_SYMBOLS = 1 << 19
END = 0


def suffix_order(symbols: np.ndarray, sigma: int) -> np.ndarray:
    """Positions of all suffixes in order. A suffix stops at its END; equal ones follow their position.

    Suffixes are sorted by their first symbols packed into one number, then ranks of doubled length split the ties.
    """
    n = len(symbols)
    place = max(1, (n - 1).bit_length())
    bits = max(1, (sigma - 1).bit_length())
    take = max(1, (62 - place) // bits)
    key = np.zeros(n, np.int64)
    part = symbols.astype(np.int64)
    alive = np.ones(n, bool)
    for k in range(take):
        m = max(0, n - k)
        own = np.zeros(n, np.int64)
        own[:m] = np.where(alive[:m], part[n - m :], 0)
        key = (key << bits) | own
        alive[:m] &= part[n - m :] != END
    packed = np.sort((key << place) | np.arange(n))
    order = packed & ((1 << place) - 1)
    packed >>= place
    new = np.ones(n, bool)
    new[1:] = packed[1:] != packed[:-1]
    new |= ~alive[order]  # it has stopped: the position decides
    length = take
    while True:
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        open_ = np.flatnonzero(~(new & last))
        if not len(open_):
            return order
        rank = np.empty(n, np.int64)
        rank[order] = group
        at = order[open_]
        packed = np.sort((group[open_] << (2 * place)) | (rank[np.minimum(at + length, n - 1)] << place) | at)
        order[open_] = packed & ((1 << place) - 1)
        packed >>= place
        differs = np.ones(len(open_), bool)
        differs[1:] = packed[1:] != packed[:-1]
        new[open_] |= differs
        length *= 2


class FmIndex:
    """Index of ``symbols`` (each text closed by END), with every ``step``-th position and every text's start sampled."""

    def __init__(self, symbols: np.ndarray, sigma: int, step: int = 8):
        self.n = n = len(symbols)
        order = suffix_order(symbols, sigma)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma))))
        starts = np.zeros(n, bool)
        starts[0] = True
        starts[1:] = symbols[:-1] == END
        sampled = starts | (np.arange(n) % step == 0)
        self.is_sampled = sampled[order]
        self.sample_rank = np.cumsum(self.is_sampled, dtype=np.int32)
        self.samples = order[self.is_sampled]
        last = symbols[order - 1]
        self.levels = max(1, (sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = ((last >> level) & 1).astype(bool)
            self.ones.append(np.concatenate((np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(n - int(self.ones[-1][-1]))
            last = np.concatenate((last[~bit], last[bit]))
        symbol = np.arange(sigma)
        self.first = self._descend(symbol, np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[k][at]
            at = np.where((symbol >> level) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first ``at`` places of the transformed text."""
        return self._descend(symbol, at) - self.first[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that start with each pattern (patterns of one length, one per row)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, k]
            low[alive] = self.before[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled one."""
        out, which, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(which):
            here = self.is_sampled[rows]
            out[which[here]] = self.samples[self.sample_rank[rows[here]] - 1] + steps
            which, rows, steps = which[~here], rows[~here], steps + 1
            at, symbol = rows, np.zeros(len(rows), np.int64)
            for k in range(self.levels):
                ones = self.ones[k][at]
                bit = self.ones[k][at + 1] > ones
                symbol = symbol * 2 + bit
                at = np.where(bit, self.zeros[k] + ones, at - ones)
            rows = self.before[symbol] + at - self.first[symbol]
        return out
