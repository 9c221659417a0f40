"""Shingle sets and fast similarity sketches in numpy."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .words import split

SHINGLE = 5
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public constants of the splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    A-Z are lower-cased, words end at ASCII white space. With fewer than ``size`` words the whole
    sequence is one shingle; without words the set is empty.
    """
    at, distinct, ends = split(pc.ascii_lower(texts))
    values = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)[at]
    rolled = values * _MULTIPLIERS[0]
    for k in range(1, size):
        # position i holds words i..i+k; what runs past a text's end is cut below
        rolled = mix(rolled[: max(0, len(values) - k)]) + values[k:] * _MULTIPLIERS[k % 5]
    rolled = mix(rolled)
    out, start = [], 0
    for end in ends.tolist():
        n = end - start
        if n >= size:
            out.append(np.unique(rolled[start : end - size + 1]))
        elif n:
            whole = values[start : start + 1] * _MULTIPLIERS[0]
            for k in range(1, n):
                whole = mix(whole) + values[start + k : start + k + 1] * _MULTIPLIERS[k % 5]
            out.append(mix(whole + np.uint64(n)))
        else:
            out.append(values[:0])
        start = end
    return out


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketching: t coordinates of a non-empty set of 64-bit hashes.

    In round i < t each item is thrown into a random bin, in round t + b into bin b; a bin keeps
    the least (round, hash). Rounds go on until every bin is filled, which round 2t - 1
    guarantees. Equal coordinates have the Jaccard similarity as probability, with concentration
    as strong as that of t independent hash functions up to constants.
    """
    n = len(items)
    best = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    empty = np.iinfo(np.uint64).max
    first = 0
    block = max(1, math.ceil(t * (math.log(t) + 2) / n))
    while first < 2 * t:
        last = min(first + block, t if first < t else 2 * t)
        i = np.arange(first, last, dtype=np.uint64)[:, None]
        h = mix(items[None, :] + mix(i * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
        value = (i << np.uint64(52)) | (h >> np.uint64(12))
        bins = mix(h + np.uint64(0x632BE59BD9B4E019)) % np.uint64(t) if first < t else np.broadcast_to(i - np.uint64(t), h.shape)
        np.minimum.at(best, bins.ravel().astype(np.int64), value.ravel())
        first = last
        # a whole block may run past the round that filled the last bin; later rounds only hold larger values
        if (best != empty).all():
            break
    return best


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates; the band's number is part of it."""
    bands = coordinates.reshape(-1, rows)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(rows):
        key = mix(key + bands[:, k])
    return key
