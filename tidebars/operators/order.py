"""Order statistics of sliding windows, at a cost that does not depend on their width."""

from __future__ import annotations

import numpy as np


class WindowRanks:
    """Ranks and quantiles within any stretch of a series.

    A wavelet matrix over the values' ranks: one row of counts per bit of the largest rank. A question about a
    stretch walks down the bits, and all questions walk together, so n of them take n log n steps.
    NaNs are not allowed; give them some value and leave out the stretches that hold them.
    """

    def __init__(self, values: np.ndarray):
        self.values, self.ranks = np.unique(values, return_inverse=True)
        self.bits = max(1, (len(self.values) - 1).bit_length())
        self.zeros, row = [], self.ranks
        for bit in range(self.bits - 1, -1, -1):
            low = (row >> bit) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(low)]))
            row = np.concatenate([row[low], row[~low]])

    def kth(self, first: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with ``k`` values before it in the sorted stretch ``[first, end)``."""
        rank = np.zeros(len(first), "i8")
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b = zeros[first], zeros[end]
            here = k < b - a
            rank += np.where(here, 0, 1 << bit)
            k = np.where(here, k, k - (b - a))
            first, end = np.where(here, a, zeros[-1] + first - a), np.where(here, b, zeros[-1] + end - b)
        return self.values[rank]

    def below(self, first: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many values of the stretch have a rank below ``rank`` (as in ``ranks``)."""
        width, count = end - first, np.zeros(len(first), "i8")
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b = zeros[first], zeros[end]
            one = (rank >> bit) & 1 == 1
            count += np.where(one, b - a, 0)
            first, end = np.where(one, zeros[-1] + first - a, a), np.where(one, zeros[-1] + end - b, b)
        return np.where(rank >= 1 << self.bits, width, count)
