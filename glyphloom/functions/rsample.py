"""Sampling without replacement as R's sample() has it since version 3.6: Mersenne Twister, rejection, and sequential draws with weights.

Written from R's public documentation of its generators; results are tested against published draws.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: How a seed is scrambled, and the factor from 32 bits to (0, 1) (fixed values of the generator).
SCRAMBLE, WARM_UP, WORDS, UNIT = 69069, 50, 624, 2.3283064365386963e-10


class RSample:
    """A stream of draws; later draws go on where earlier ones ended."""

    def __init__(self, seed: int):
        state, x = [], seed & 0xFFFFFFFF
        for k in range(WARM_UP + 1 + WORDS):
            x = (SCRAMBLE * x + 1) & 0xFFFFFFFF
            if k >= WARM_UP + 1:
                state.append(x)
        self.bits = np.random.MT19937()
        self.bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(state, np.uint32), "pos": WORDS}}

    def uniform(self) -> float:
        return min(max(int(self.bits.random_raw()) * UNIT, 0.5 * UNIT), 1 - 0.5 * UNIT)

    def below(self, n: int) -> int:
        """A whole number from 0 to n - 1: as many bits as n - 1 needs, drawn 16 at a time, until they are below n."""
        need = max(0, (n - 1).bit_length())
        while True:
            value = 0
            for _ in range(0, need + 1, 16):
                value = (value << 16) + int(self.uniform() * 65536)
            value &= (1 << need) - 1
            if value < n:
                return value

    def places(self, n: int, size: int) -> list[int]:
        """size of the places 0 to n - 1. Only those that were drawn are held, so n may be large."""
        if size > n:
            raise ValueError("a sample without replacement can't be larger than what it is taken from")
        moved: dict[int, int] = {}
        out = []
        for left in range(n, n - size, -1):
            at = self.below(left)
            out.append(moved.get(at, at))
            moved[at] = moved.get(left - 1, left - 1)
        return out

    def weighted(self, weights: Sequence[float], size: int) -> list[int]:
        """size places, each drawn with its weight among those left, heaviest first in the order of the search."""
        p = np.asarray(weights, float)
        if size > (p > 0).sum():
            raise ValueError("too few places have a weight")
        order = np.argsort(-p, kind="stable")
        p, total, out = p[order] / p.sum(), 1.0, []
        for _ in range(size):
            mass = np.cumsum(p)
            at = min(int(np.searchsorted(mass, total * self.uniform())), len(p) - 1)
            out.append(int(order[at]))
            total -= p[at]
            p, order = np.delete(p, at), np.delete(order, at)
        return out
