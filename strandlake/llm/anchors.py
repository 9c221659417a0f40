"""Content-chosen anchor positions in bytes, and fingerprints of any stretch, in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_SYMBOLS = _rng.integers(1, 2**63, (2, 256)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public constants of the splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the bases and of their inverses modulo 2^64."""
    if not _POWERS or len(_POWERS[0][0]) <= n:
        _POWERS.clear()
        for base in _BASES:
            pair = []
            for b in (base, pow(base, -1, 2**64)):
                x = np.full(max(n + 1, 1 << 16), b, np.uint64)
                x[0] = 1
                pair.append(np.multiply.accumulate(x))
            _POWERS.append(tuple(pair))
    return _POWERS


class Fingerprints:
    """Of any stretch of a buffer, by prefix sums: two 64-bit numbers."""

    def __init__(self, buffer: np.ndarray, which: int = 2):
        n = len(buffer)
        self.inverse, self.sums = [], []
        for symbols, (up, down) in list(zip(_SYMBOLS, _powers(n), strict=True))[:which]:
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols[buffer] * up[:n], dtype=np.uint64)]))
            self.inverse.append(down)

    def of(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        return mix((s[end] - s[start]) * self.inverse[which][start] + (end - start).astype(np.uint64))


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over x[i : i + width] for every full window (blockwise running extremes from both sides)."""
    n = len(x)
    if n < width:
        return x[:0]
    pad = -n % width
    fill = x[-1] if pad else 0
    y = np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(-1, width)
    ahead = best.accumulate(y, axis=1).ravel()
    back = best.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - width + 1], ahead[width - 1 : n])


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions whose value is the least in at least one window of ``width`` values; all of equal ones."""
    least = _sliding(grams, width, np.minimum)
    if not len(least):
        return np.zeros(0, np.int64)
    # position i is an anchor if it equals the least of one of the windows that hold it: the largest of these minima
    padded = np.concatenate([np.zeros(width - 1, grams.dtype), least, np.zeros(width - 1, grams.dtype)])
    return np.flatnonzero(_sliding(padded, width, np.maximum) == grams)
