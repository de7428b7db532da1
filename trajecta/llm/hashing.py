"""Hashes of byte blocks as array operations."""

from __future__ import annotations

import hashlib

import numpy as np


def mixed(h):
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Hasher:
    """Hashes of all q-grams of a byte block."""

    def __init__(self, q: int, seed: int = 20):
        self.q, self.gram = q, np.random.default_rng(seed).integers(0, 2**64, 256, np.uint64)
        self.p = np.uint64(0x9E3779B97F4A7C15)

    def grams(self, buf):
        """Hash of the q bytes from each position, by doubling."""
        h, p, width, left = self.gram[buf], self.p, 1, self.q
        out, done = None, 0
        while left:
            if left & 1:
                n = len(h) - done if out is None else min(len(out), len(h) - done)
                part = h[done : done + max(n, 0)]
                out = part if out is None else out[: len(part)] * p + part
                done += width
            left >>= 1
            if left:
                h, p, width = h[:-width] * p + h[width:], np.uint64(int(p) ** 2 % 2**64), 2 * width
        return mixed(out)


def digests(buf, start, stop, numbers: int = 1):
    """BLAKE2b of each run of bytes, as ``numbers`` 64-bit numbers."""
    data, size, blake = memoryview(buf), 8 * numbers, hashlib.blake2b
    made = b"".join([blake(data[i:j], digest_size=size).digest() for i, j in zip(start.tolist(), stop.tolist(), strict=True)])
    return np.frombuffer(made, np.int64).reshape(-1, numbers).T


def sliding_minimum(v, width: int):
    w = 1
    while 2 * w <= width:
        v, w = np.minimum(v[:-w], v[w:]), 2 * w
    return np.minimum(v[: len(v) - (width - w)], v[width - w :]) if w < width else v
