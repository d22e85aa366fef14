"""Static 3-wise binary fuse filter over 64-bit keys, built and probed in numpy (Graf and Lemire, 2022)."""

from __future__ import annotations

import math

import numpy as np

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class BinaryFuse:
    """8-bit fingerprints: no false negatives, about 1/256 false positives, about 9 bits a key."""

    def __init__(self, seed: int, segment: int, count: int, prints: np.ndarray):
        self.seed, self.segment, self.count, self.prints = seed, segment, count, prints

    @staticmethod
    def _shape(n: int) -> tuple[int, int]:
        segment = 4 if n <= 1 else 1 << min(18, max(2, int(math.floor(math.log(n) / math.log(3.33) + 2.25))))
        factor = 2.0 if n <= 1 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        return segment, max(1, -(-round(n * factor) // segment) - 2)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(np.asarray(keys, dtype=U))
        n = len(keys)
        segment, count = cls._shape(n)
        for seed in range(1, 200):
            made = cls(seed, segment, count, np.zeros((count + 2) * segment, dtype=np.uint8))
            if n == 0 or made._fill(keys):
                return made
            if seed % 8 == 0:
                count += max(1, count // 8)
        raise RuntimeError("no peeling order found")

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            h = _mix(np.asarray(keys, dtype=U) + U(self.seed) * U(0x9E3779B97F4A7C15))
        mask = U(self.segment - 1)
        first = ((h >> U(32)) * U(self.count * self.segment)) >> U(32)
        second = (first + U(self.segment)) ^ ((h >> U(18)) & mask)
        third = (first + U(2 * self.segment)) ^ (h & mask)
        return np.stack([first, second, third], axis=1).astype(np.int64), ((h ^ (h >> U(32))) & U(255)).astype(np.uint8)

    def _fill(self, keys: np.ndarray) -> bool:
        places, prints = self._places(keys)
        size, n = len(self.prints), len(keys)
        flat, owner = places.ravel(), np.repeat(np.arange(n), 3)
        load = np.bincount(flat, minlength=size)
        owners = np.bincount(flat, weights=owner, minlength=size).astype(np.int64)
        rounds, done, front = [], 0, np.flatnonzero(load == 1)
        while len(front):
            peeled, at = np.unique(owners[front], return_index=True)
            rounds.append((peeled, front[at]))
            done += len(peeled)
            touched = places[peeled].ravel()
            np.subtract.at(load, touched, 1)
            np.subtract.at(owners, touched, np.repeat(peeled, 3))
            touched = np.unique(touched)
            front = touched[load[touched] == 1]
        if done < n:
            return False
        for peeled, slot in reversed(rounds):
            # the slot itself is still 0, so the xor over all three is that of the other two
            p = places[peeled]
            self.prints[slot] = prints[peeled] ^ self.prints[p[:, 0]] ^ self.prints[p[:, 1]] ^ self.prints[p[:, 2]]
        return True

    def has(self, keys: np.ndarray) -> np.ndarray:
        places, prints = self._places(keys)
        return (self.prints[places[:, 0]] ^ self.prints[places[:, 1]] ^ self.prints[places[:, 2]]) == prints
