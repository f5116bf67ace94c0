"""Word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np

WIDTH = 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FACTORS = tuple(np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))  # taken in turns
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_up, _down = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> None:
    global _up, _down
    while len(_up) < n:
        step, back = pow(int(_BASE), len(_up), 1 << 64), pow(int(_INVERSE), len(_up), 1 << 64)
        _up, _down = np.concatenate([_up, _up * np.uint64(step)]), np.concatenate([_down, _down * np.uint64(back)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words."""
    n = len(words) - width + 1
    runs = words[: max(0, n)] * _FACTORS[0]
    for k in range(1, width if n > 0 else 1):
        runs = _mixed(runs) + words[k : n + k] * _FACTORS[k % len(_FACTORS)]
    return _mixed(runs)


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct hashes (as signed numbers) of its runs of ``width`` words; of fewer words, the hash of
    them all; none of a text without words. Words are split at ASCII white space, A to Z count as a to z."""
    if not texts:
        return []
    raw = b"\n".join([t.encode("utf-8", "surrogatepass").lower() for t in texts]) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(t.encode("utf-8", "surrogatepass")) if not t.isascii() else len(t) for t in texts])
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _up[: len(data)])])
    words = _mixed((sums[ends] - sums[starts]) * _down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes + 1)]))
    runs = _runs(words, width)
    found = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = runs[a : b - width + 1] if b - a >= width else _runs(words[a:b], b - a) if b > a else runs[:0]
        found.append(np.unique(own.view(np.int64)))
    return found


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that stand for a set of hashes."""
    x = hashes.view(np.uint64)
    return int(_mixed(x + _FACTORS[0]).sum().view(np.int64)), int(_mixed(x ^ _FACTORS[1]).sum().view(np.int64))
