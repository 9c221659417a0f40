"""Reads as arrays of two-bit codes: minimizers and their partitions for all positions at once, in numpy.

A base is worth 0..3 by the bits of its letter, of any case (N counts as G); an m-mer of at most 31 bases is a
number that sorts like its text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .hashes import quick_hash_array

_LETTERS = np.arange(256, dtype=np.uint8)
_HIGH = (_LETTERS & 4) >> 1
CODES = _HIGH + ((_HIGH ^ (_LETTERS & 2)) >> 1)
#: Letters that count as a base: A, C, G, T of either case.
CLEAN = np.isin(_LETTERS, np.frombuffer(b"ACGTacgt", np.uint8))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets: one more than texts) of an array without nulls."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (whole[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(texts) else (whole[:0], np.zeros(1, np.int64))


def canonical_mmers(codes: np.ndarray, m: int) -> np.ndarray:
    """At each position the lesser of the m-mer that starts there and of its reverse complement."""
    n = max(0, len(codes) - m + 1)
    forward, back = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(m):
        x = codes[j : j + n].astype(np.uint64)
        forward |= x << np.uint64(2 * (m - 1 - j))
        back |= (np.uint64(3) - x) << np.uint64(2 * j)
    return np.minimum(forward, back)


def minimizers(codes: np.ndarray, k: int, m: int) -> np.ndarray:
    """At each position the greatest canonical m-mer of the k-mer that starts there."""
    mmers = canonical_mmers(codes, m)
    n = max(0, len(codes) - k + 1)
    out = mmers[:n].copy()
    for j in range(1, k - m + 1):
        np.maximum(out, mmers[j : j + n], out=out)
    return out


def targets_of(codes: np.ndarray, m: int, targets: int) -> np.ndarray:
    """The partition, of so many, of packed minimizers: by the hash of their left-aligned words."""
    return (quick_hash_array(codes << np.uint64(64 - 2 * m)) % np.uint64(targets)).astype(np.int32)


def spelled(codes: np.ndarray, m: int) -> pa.Array:
    """Packed m-mers as text."""
    letters = np.frombuffer(b"ACGT", np.uint8)
    out = np.empty((len(codes), m), np.uint8)
    for j in range(m):
        out[:, j] = letters[((codes >> np.uint64(2 * (m - 1 - j))) & np.uint64(3)).astype(np.int64)]
    return slices(out.ravel(), np.arange(len(codes)) * m, np.full(len(codes), m))


def slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Stretches of bytes as an array of text."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes())).cast(pa.string())


def interior(data: np.ndarray, offsets: np.ndarray, k: int, clean_only: bool) -> np.ndarray:
    """Positions in all bytes at which a k-mer starts that has a base on either side, within its own text.

    With ``clean_only`` the k-mer has only A, C, G, T (of either case), and no N stands beside it.
    """
    n = len(data)
    lengths = np.diff(offsets)
    first, last = offsets[:-1] + 1, offsets[1:] - k - 1  # both included
    some = lengths >= k + 2
    marks = np.zeros(n + 2, np.int64)
    np.add.at(marks, first[some], 1)
    np.add.at(marks, last[some] + 1, -1)
    able = np.cumsum(marks)[: n + 1] > 0
    at = np.flatnonzero(able)
    if clean_only and len(at):
        bad = np.concatenate([[0], np.cumsum(~CLEAN[data])])
        at = at[(bad[at + k] == bad[at]) & (data[at - 1] != ord("N")) & (data[at + k] != ord("N"))]
    return at
