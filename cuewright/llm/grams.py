"""Hashed character n-grams in numpy: many texts at once, tables of a fixed size."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Separates texts; no n-gram crosses it.
SEP = 0


def join_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a separator before, between and after them, and each one's text number."""
    raw = "\0" + "\0".join(texts) + "\0"
    points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return points, np.cumsum(points == SEP) - 1


class Windows:
    """Hashes of all n-grams of an array of points, for any n at the cost of a few passes over it.

    Sums of points times powers of an odd base are kept, modulo 2**64; the difference of two sums, taken
    back by the inverse power, is the hash of what lies between, wherever it stands.
    """

    def __init__(self, points: np.ndarray):
        size = len(points)
        with np.errstate(over="ignore"):
            power = np.full(size, _BASE, np.uint64)
            back = np.full(size, _INVERSE, np.uint64)
            if size:
                power[0] = back[0] = 1
            np.multiply.accumulate(power, out=power)
            self.back = np.multiply.accumulate(back)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(points * power)])
        last = np.maximum.accumulate(np.where(points == SEP, np.arange(size), -1)) if size else np.empty(0, np.int64)
        self.run = np.arange(size) - last  # points since the last separator

    def hashes(self, n: int) -> np.ndarray:
        """Hash of the n points that end at each position; 0 where a separator is among them or there are too few."""
        size = len(self.run)
        h = np.zeros(size, np.uint64)
        if size < n:
            return h
        with np.errstate(over="ignore"):
            x = (self.sums[n:] - self.sums[:-n]) * self.back[n - 1 :]
            x = (x ^ (x >> np.uint64(29))) * _MIX + np.uint64(n)
            x ^= x >> np.uint64(32)
        h[n - 1 :] = x
        h[self.run < n] = 0
        return h


def rolling(points: np.ndarray, n: int) -> np.ndarray:
    return Windows(points).hashes(n)


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h * _BASE) >> np.uint64(64 - bits)).astype(np.int64)
