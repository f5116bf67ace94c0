"""A wavelet matrix over token ids: one bit-plane for each bit of an id, most significant first.

On each plane, ids whose bit is 0 move to the front and the others behind them, in order. Popcounts of 512-bit blocks
make rank a lookup and select a binary search. That answers which id stands at a place, how often an id occurs before
a place, and where its k-th occurrence is, from the planes alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 64  # bytes of a plane between two stored ranks
STEP = 1 << 18  # places moved at once; small enough for a core's cache


@dataclass
class WaveletMatrix:
    """``planes``: packed bits; ``ranks``: ones before each block; ``zeros``: zeros of each plane."""

    n: int
    zeros: list[int]
    planes: list[np.ndarray]
    ranks: list[np.ndarray]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        ids = ids.astype(np.uint16 if bits <= 16 else np.uint32, copy=False)
        zeros, planes, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            one = (ids & ids.dtype.type(1 << level)).astype(bool)
            plane = np.packbits(one, bitorder="little")
            planes.append(plane)
            ranks.append(cls._directory(plane))
            zeros.append(len(ids) - int(np.bitwise_count(plane).sum()))
            ids = cls._parted(ids, one, zeros[-1])
        return cls(int(len(ids)), zeros, planes, ranks)

    @staticmethod
    def _parted(ids: np.ndarray, one: np.ndarray, zeros: int) -> np.ndarray:
        """Ids with bit 0 in front, those with bit 1 behind, in order."""
        out, low, high = np.empty_like(ids), 0, zeros
        for a in range(0, len(ids), STEP):
            part = ids[a : a + STEP]
            at = np.flatnonzero(~one[a : a + STEP])
            out[low : low + len(at)] = part[at]
            low += len(at)
            at = np.flatnonzero(one[a : a + STEP])
            out[high : high + len(at)] = part[at]
            high += len(at)
        return out

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-max(1, len(plane)) // BLOCK) * BLOCK, np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    def decode(self) -> np.ndarray:
        """All ids: the planes undone from the last to the first."""
        bits = len(self.planes)
        ids = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for level, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            before, low, high, bit = np.empty_like(ids), 0, z, ids.dtype.type(1 << level)
            for a in range(0, self.n, STEP):
                part = before[a : a + STEP]
                at = np.flatnonzero(~one[a : a + STEP])
                part[at] = ids[low : low + len(at)]
                low += len(at)
                at = np.flatnonzero(one[a : a + STEP])
                part[at] = ids[high : high + len(at)] | bit
                high += len(at)
            ids = before
        return ids

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, byte = i // (8 * BLOCK), i // 8
        plane = self.planes[level]
        ones = int(self.ranks[level][block]) + int(np.bitwise_count(plane[block * BLOCK : byte]).sum())
        return ones + (int(plane[byte] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> (i % 8) & 1

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        value = 0
        for level, z in enumerate(self.zeros):
            bit = self._bit(level, i)
            value = value << 1 | bit
            ones = self._ones(level, i)
            i = z + ones if bit else i - ones
        return value

    def _span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` among places lo to hi stand below the last plane."""
        bits = len(self.planes)
        if token >> bits:
            return 0, 0
        for level, z in enumerate(self.zeros):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (z + a, z + b) if token >> (bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` among places lo to hi (excluded)."""
        a, b = self._span(token, lo, self.n if hi is None else hi)
        return b - a

    def _find(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of a kind on a plane."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * (8 * BLOCK) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = self.planes[level][block * BLOCK : (block + 1) * BLOCK]
        room = min(self.n - block * 8 * BLOCK, 8 * BLOCK)
        places = np.flatnonzero(np.unpackbits(part, count=room, bitorder="little") == bit)
        return block * 8 * BLOCK + int(places[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``token``; -1 if there are fewer."""
        lo, hi = self._span(token, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i, bits = lo + k, len(self.planes)
        for level in range(bits - 1, -1, -1):
            bit = token >> (bits - 1 - level) & 1
            i = self._find(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> np.ndarray:
        """All places of ``token``."""
        return np.array([self.select(token, k) for k in range(self.count(token))], np.int64)
