"""Minimal perfect hash over 64-bit keys: cascaded bit arrays without collisions.

At each level every remaining key picks a slot; keys alone in their slot stay, the others go
to the next, smaller level. A key's number is the rank of its bit over all levels, so n keys
get the numbers 0 to n-1. A non-member usually finds no bit, or a bit whose stored
fingerprint differs.
"""

from __future__ import annotations

import io

import numpy as np

GAMMA = 1.5
MAX_LEVELS = 48


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers for each seed (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        z = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)


class MinimalPerfectHash:
    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self._ranks, self._bases, base = [], [], 0
        for bits in levels:
            self._ranks.append(np.cumsum(bits, dtype=np.int64) - bits)
            self._bases.append(base)
            base += int(bits.sum())
        self._rest_base = base
        self.n = base + len(rest)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """``keys``: distinct int64."""
        levels = []
        while len(keys) and len(levels) < MAX_LEVELS:
            m = max(8, int(len(keys) * GAMMA))
            at = (mix(keys, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """0 to n-1 for members; any number or -1 for others (check the fingerprint)."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            if not len(open_):
                return out
            at = (mix(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self._bases[k] + self._ranks[k][at[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self._rest_base + at[hit]
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=np.array([len(b) for b in self.levels], np.int64), bits=np.packbits(np.concatenate([*self.levels, np.zeros(0, bool)])), rest=self.rest)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> MinimalPerfectHash:
        with np.load(io.BytesIO(raw)) as x:
            sizes = x["sizes"]
            bits = np.unpackbits(x["bits"], count=int(sizes.sum())).astype(bool)
            return cls(np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else [], x["rest"])
