"""Prefix polynomial hashes: after one pass, the hash of any span is two look-ups and a product.

sum(code[i] * base**i) is kept as a running sum for two bases modulo the prime 2**31 - 1, so the
hash of a span is (sums[end] - sums[start]) / base**start. Two hashes make 62 bits.
"""

from __future__ import annotations

import numpy as np

PRIME = (1 << 31) - 1
BASES = (1_103_515_247, 1_597_334_677)
_P, _S = np.uint64(PRIME), np.uint64(31)
_powers: dict[int, np.ndarray] = {}


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _S)
    x = (x & _P) + (x >> _S)
    return np.where(x >= _P, x - _P, x)


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo the prime, for i up to n at least; kept and doubled as longer ones are asked for."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) <= n:
        have = np.concatenate([have, _reduce(have * np.uint64(pow(base, len(have), PRIME)))])
    _powers[base] = have
    return have


class PrefixHash:
    """Hashes of all spans of ``codes`` (bytes, code points or other integers below 2**31)."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        codes = codes.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for base in BASES:
            sums = np.zeros(self.n + 1, np.uint64)
            x = codes * powers(base, self.n)[: self.n]
            np.cumsum((x & _P) + (x >> _S), out=sums[1:])
            self.sums.append(sums)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hash of each codes[start:end]; equal spans have equal hashes wherever they lie."""
        out = None
        for base, sums in zip(BASES, self.sums, strict=True):
            h = _reduce(_reduce(sums[end] - sums[start]) * powers(pow(base, PRIME - 2, PRIME), self.n)[start])
            out = h if out is None else (out << _S) | h
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.spans(a, a + length) == self.spans(b, b + length)

    def common_extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common extension to the right of each pair of places, up to ``most``, by binary search."""
        low, high = np.zeros_like(most), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) // 2
            same = self.equal(a[open_], b[open_], mid)
            low[open_] = np.where(same, mid, low[open_])
            high[open_] = np.where(same, high[open_], mid - 1)
