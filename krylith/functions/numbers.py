"""Random streams, byte order and index ranges."""

from __future__ import annotations

import numpy as np


class Twister:
    """The 32-bit Mersenne twister, seeded by a number or by a list of them."""

    def __init__(self, seed: int | list[int] = 5489):
        self.state = np.random.RandomState()
        self.state.seed(seed if isinstance(seed, int) else np.asarray(seed, np.uint32))

    def int32(self, n: int) -> np.ndarray:
        """n integers of 32 bits."""
        return self.state.randint(0, 2**32, n, np.uint32)

    def int31(self, n: int) -> np.ndarray:
        return self.int32(n) >> np.uint32(1)

    def closed(self, n: int) -> np.ndarray:
        """Numbers of [0, 1] from 32 bits."""
        return self.int32(n) * (1.0 / 4294967295.0)

    def half_open(self, n: int) -> np.ndarray:
        """Numbers of [0, 1) from 32 bits."""
        return self.int32(n) * (1.0 / 4294967296.0)

    def open(self, n: int) -> np.ndarray:
        """Numbers of (0, 1) from 32 bits."""
        return (self.int32(n) + 0.5) * (1.0 / 4294967296.0)

    def precise(self, n: int) -> np.ndarray:
        """Numbers of [0, 1) from 53 bits."""
        return self.state.random_sample(n)


def swapped(values: np.ndarray) -> np.ndarray:
    """The same numbers with their bytes in the other order."""
    return values.byteswap()


def even_ranges(n: int, parts: int) -> list[int]:
    """Starts of even shares of n, the first ones larger by one, and n at the end."""
    base, more = divmod(n, parts)
    return [k * base + min(k, more) for k in range(parts + 1)]
