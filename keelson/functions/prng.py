"""SplitMix64, by position: the n-th output is mix(seed + n * PHI), so draws need no state."""

from __future__ import annotations

import numpy as np

#: Fixed values of SplitMix64.
PHI = 0x9E3779B97F4A7C15
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), 31)
_MASK = (1 << 64) - 1


def derive_seed(base: int, run: int) -> int:
    """Seed of a run: base plus run steps of PHI, modulo 2**64."""
    return (base + run * PHI) & _MASK


def draws(seed: int, first: int, count: int) -> np.ndarray:
    """Outputs number `first` to `first + count - 1` (from 1) as uint64."""
    state = np.uint64(seed & _MASK) + np.arange(first, first + count, dtype=np.uint64) * np.uint64(PHI)
    for shift, factor in MIX[:2]:
        state = (state ^ (state >> np.uint64(shift))) * np.uint64(factor)
    return state ^ (state >> np.uint64(MIX[2]))


class Stream:
    """Successive draws, made in blocks."""

    def __init__(self, seed: int, block: int = 4096):
        self._seed, self._block, self._next = seed, block, 1
        self._held: list[int] = []
        self._at = 0

    def bits(self) -> int:
        """The next 64 bits."""
        if self._at == len(self._held):
            self._held = draws(self._seed, self._next, self._block).tolist()
            self._next += self._block
            self._at = 0
        self._at += 1
        return self._held[self._at - 1]

    def unit(self) -> float:
        """A number from 0 to 1 (exclusive but for rounding)."""
        return float(self.bits()) / 18446744073709551616.0

    def below(self, bound: int) -> int:
        """A number below bound, of two draws; none are used where only 0 is possible."""
        if bound <= 1:
            return 0
        upper = self.bits()
        return ((upper << 64) | self.bits()) % bound


def zipf_cdf(size: int, s: float) -> np.ndarray:
    """Running shares of 1 / rank**s over ranks 1 to size."""
    weights = 1.0 / np.arange(1, size + 1, dtype=np.float64) ** s
    total = 0.0
    for w in weights.tolist():  # summed from left to right, as the shares are
        total += w
    return np.add.accumulate(weights / total)
