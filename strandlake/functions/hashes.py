"""Unsigned 64-bit hashes. Spark has no wrapping multiplication, so these are vectorised UDFs on numpy's uint64.

Numbers go in as longs (the same 64 bits) or as k-mer text and come out as DECIMAL(20,0), which holds any unsigned value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Holds any unsigned 64-bit value.
UNSIGNED = T.DecimalType(20, 0)
U = np.uint64
# Multipliers, addend, shifts and seed of the three public hash functions.
QUICK = (3935559000370003845, 2691343689449507681, 4768777513237032717)
QUICK_SHIFTS = ((">", 21), ("<", 37), (">", 4)), (("<", 20), (">", 41), ("<", 5))
MURMUR3 = (0x87C37B91114253D5, 0x4CF5AD432745937F, 0x52DCE729, 0x38495AB5)
MURMUR3_FINAL = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
MURMUR3_SEED = 313
MURMUR2 = (0xC6A4A7935BD1E995, 47)


def _shifted(v: np.ndarray, steps) -> np.ndarray:
    for way, n in steps:
        v = v ^ (v >> U(n) if way == ">" else v << U(n))
    return v


def quick_hash_array(v: np.ndarray) -> np.ndarray:
    v = _shifted(v * U(QUICK[0]) + U(QUICK[1]), QUICK_SHIFTS[0])
    return _shifted(v * U(QUICK[2]), QUICK_SHIFTS[1])


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def murmur3_array(words: np.ndarray, seed: int = MURMUR3_SEED) -> np.ndarray:
    """The low 64 bits of the 128-bit x64 variant over rows of whole 64-bit words."""
    c1, c2, a1, a2 = (U(c) for c in MURMUR3)
    h1 = np.full(len(words), seed, U)
    h2 = h1.copy()
    n = words.shape[1]
    for i in range(0, n - 1, 2):
        h1 = (_rotated(h1 ^ (_rotated(words[:, i] * c1, 31) * c2), 27) + h2) * U(5) + a1
        h2 = (_rotated(h2 ^ (_rotated(words[:, i + 1] * c2, 33) * c1), 31) + h1) * U(5) + a2
    if n % 2:
        h1 = h1 ^ (_rotated(words[:, -1] * c1, 31) * c2)
    h1, h2 = h1 ^ U(8 * n), h2 ^ U(8 * n)
    h1 = h1 + h2
    h2 = h2 + h1

    def final(h: np.ndarray) -> np.ndarray:
        for c in MURMUR3_FINAL:
            h = (h ^ (h >> U(33))) * U(c)
        return h ^ (h >> U(33))

    return final(h1) + final(h2)


def murmur2_array(words: np.ndarray, seed: int) -> np.ndarray:
    """The 64-bit A variant over rows of whole 64-bit words."""
    m, r = U(MURMUR2[0]), U(MURMUR2[1])
    h = np.full(len(words), (seed ^ (8 * words.shape[1] * MURMUR2[0])) % 2**64, U)
    for i in range(words.shape[1]):
        k = words[:, i] * m
        h = (h ^ ((k ^ (k >> r)) * m)) * m
    h = (h ^ (h >> r)) * m
    return h ^ (h >> r)


def packed_words(kmers: pd.Series, n_words: int) -> np.ndarray:
    """Left-aligned words of 32 bases, two bits each, letters by their bits."""
    out = np.zeros((len(kmers), n_words), U)
    lengths = kmers.str.len().to_numpy()
    for length in np.unique(lengths) if len(kmers) else []:
        rows = np.flatnonzero(lengths == length)
        raw = np.frombuffer("".join(kmers.iloc[rows]).encode("ascii", "replace"), np.uint8).reshape(len(rows), -1)
        high = (raw & 4) >> 1
        code = (high + ((high ^ (raw & 2)) >> 1)).astype(U)
        for i in range(code.shape[1]):
            out[rows, i // 32] |= code[:, i] << U(62 - 2 * (i % 32))
    return out


def _decimals(values: np.ndarray) -> pd.Series:
    exact = pa.array(values, pa.uint64()).cast(pa.decimal128(20, 0))
    return pd.Series(exact.to_pylist())


@F.pandas_udf(UNSIGNED)
def quick_hash(values: pd.Series) -> pd.Series:
    """Of a long's 64 bits."""
    return _decimals(quick_hash_array(values.to_numpy(np.int64).view(U)))


@F.pandas_udf(UNSIGNED)
def minimizer_hash(minimizers: pd.Series) -> pd.Series:
    """quick_hash of a minimizer of at most 32 bases as a left-aligned word."""
    return _decimals(quick_hash_array(packed_words(minimizers, 1)[:, 0]))


def minimizer_target(targets: int):
    """UDF: the partition, of so many, that a minimizer belongs to."""

    @F.pandas_udf(T.IntegerType())
    def target(minimizers: pd.Series) -> pd.Series:
        return pd.Series((quick_hash_array(packed_words(minimizers, 1)[:, 0]) % U(targets)).astype(np.int32))

    return target


def kmer_hash(n_words: int):
    """UDF: the slot hash of a k-mer kept in n_words words."""

    @F.pandas_udf(UNSIGNED)
    def hashed(kmers: pd.Series) -> pd.Series:
        return _decimals(murmur3_array(packed_words(kmers, n_words)))

    return hashed


@F.pandas_udf(UNSIGNED)
def key_hash(keys: pd.Series) -> pd.Series:
    """Seedless hash of a 64-bit key."""
    return _decimals(murmur3_array(keys.to_numpy(np.int64).view(U)[:, None]))


def seeded_hash(seed: int):
    """UDF: the filter's hash of a 64-bit key."""

    @F.pandas_udf(UNSIGNED)
    def hashed(keys: pd.Series) -> pd.Series:
        return _decimals(murmur2_array(keys.to_numpy(np.int64).view(U)[:, None], seed))

    return hashed
