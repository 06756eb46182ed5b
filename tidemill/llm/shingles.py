"""64-bit hashes of a text's word shingles, from prefix sums over its bytes: no Python work a word."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
TABLE = np.random.default_rng(20_240_501).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class Steps:
    """Powers of BASE and of its inverse modulo 2^64, grown to the longest text seen."""

    up = down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(BASE, -k, 1 << 64))])
        return self.up, self.down


STEPS = Steps()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[0]
    x = (x ^ (x >> np.uint64(29))) * ODD[1]
    return x ^ (x >> np.uint64(32))


def words(raw: bytes) -> np.ndarray:
    """A hash of each word (runs of other than white space, A-Z lower-cased) in order."""
    x = np.frombuffer(raw.lower(), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[x], [True]])))
    start, end = edge[::2], edge[1::2]
    up, down = STEPS.get(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(TABLE[x] * up[: len(x)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(raw: bytes, width: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words make one shingle, none make none."""
    w = words(raw)
    if not len(w):
        return w
    k = min(width, len(w))
    total = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        total = mix(total * ODD[2] + w[i : len(w) - k + 1 + i])
    return np.unique(total)
