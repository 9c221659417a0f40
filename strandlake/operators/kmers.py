"""K-mers of reads with their neighbouring bases, target partitions, and supermers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import packed, sequence


def interior_kmers(reads: DataFrame, k: int, with_rc: bool = False) -> DataFrame:
    """A row for each k-mer that has a base on either side: read_id, pos (from 0), kmer, left, right and, if asked, rc.

    The read and its reverse complement are kept as bytes, in which a slice costs no walk from the start; the
    reverse complement of a k-mer is a slice too.
    """
    raw = reads.where(F.length("seq") >= k + 2).select("read_id", F.length("seq").alias("n"), F.encode("seq", "UTF-8").alias("fwd"), F.encode(sequence.revcomp(F.col("seq")), "UTF-8").alias("back"))
    each = raw.select("read_id", "n", "fwd", "back", F.explode(F.sequence(F.lit(1), F.col("n") - (k + 1))).alias("pos"))
    cut = lambda x, at, size: F.substring(x, at, F.lit(size)).cast("string")
    columns = ["read_id", "pos", cut("fwd", F.col("pos") + 1, k).alias("kmer"), cut("fwd", F.col("pos"), 1).alias("left"), cut("fwd", F.col("pos") + (k + 1), 1).alias("right")]
    if with_rc:
        columns.append(cut("back", F.col("n") - F.col("pos") - (k - 1), k).alias("rc"))
    return each.select(*columns)


def n_as_g(reads: DataFrame) -> DataFrame:
    """Reads for those who count by the bits of letters, where an N looks like a G; case is dropped."""
    return reads.withColumn("seq", F.translate(F.upper("seq"), "N", "G"))


def canonical_kmers(reads: DataFrame, k: int) -> DataFrame:
    """Interior k-mers as the lesser of both strands, extensions swapped and complemented with them."""
    x = interior_kmers(reads, k, with_rc=True)
    rc, kmer, left, right = (F.col(c) for c in ("rc", "kmer", "left", "right"))
    return x.select(
        "read_id", "pos", F.least(kmer, rc).alias("kmer"),
        sequence.flipped(rc, kmer, left, right).alias("left"), sequence.flipped(rc, kmer, right, left).alias("right"),
    )


def masked_kmers(reads: DataFrame, k: int, reject_low_quality: bool = False) -> DataFrame:
    """Interior k-mers of reads that keep N and case: upper-cased canonical k-mers of clean windows.

    A window with an N, or with an upper-case N beside it, is dropped; a low-quality (lower-case) neighbour
    keeps the k-mer but has no vote ('0'), or drops it if ``reject_low_quality`` (contigs).
    """
    x = interior_kmers(reads, k).where(sequence.is_clean(F.col("kmer")) & (F.col("left") != "N") & (F.col("right") != "N"))
    if reject_low_quality:
        x = x.where(~sequence.low_quality(F.col("left")) & ~sequence.low_quality(F.col("right")))
    vote = lambda c: F.when(sequence.low_quality(F.col(c)), "0").otherwise(F.col(c))
    x = x.select("read_id", "pos", F.upper("kmer").alias("kmer"), vote("left").alias("left"), vote("right").alias("right"))
    x = x.withColumn("rc", sequence.revcomp(F.col("kmer")))
    rc, kmer, left, right = (F.col(c) for c in ("rc", "kmer", "left", "right"))
    return x.select(
        "read_id", "pos", F.least(kmer, rc).alias("kmer"),
        sequence.flipped(rc, kmer, left, right).alias("left"), sequence.flipped(rc, kmer, right, left).alias("right"),
    )


def _check_lengths(k: int, m: int) -> int:
    if not 0 < m <= min(k, 31):
        raise ValueError("a minimizer has 1 to 31 bases and no more than its k-mer")
    return m


def with_minimizer(kmers: DataFrame, k: int, m: int | None = None) -> DataFrame:
    """The minimizer of each k-mer as text: one Arrow pass over packed numbers."""
    m = _check_lengths(k, m or sequence.minimizer_length(k))

    @F.arrow_udf(T.StringType())
    def minimizer(kmer: pa.Array) -> pa.Array:
        return packed.spelled(_of_kmers(kmer, k, m), m)

    return kmers.withColumn("minimizer", minimizer("kmer"))


def with_target(kmers: DataFrame, k: int, targets: int, m: int | None = None) -> DataFrame:
    """The partition of each k-mer by its minimizer: both strands and most neighbours share it."""
    m = _check_lengths(k, m or sequence.minimizer_length(k))

    @F.arrow_udf(T.IntegerType())
    def target(kmer: pa.Array) -> pa.Array:
        return pa.array(packed.targets_of(_of_kmers(kmer, k, m), m, targets))

    return kmers.withColumn("target", target("kmer"))


def _of_kmers(kmer: pa.Array, k: int, m: int) -> np.ndarray:
    """Packed minimizers of texts of k bases each."""
    data, _ = packed.text_bytes(kmer)
    return packed.minimizers(packed.CODES[data], k, m)[::k][: len(kmer)]


#: Bases handled at a time; a longer read is walked in stretches of this size.
STRETCH = 1 << 21


def _stretches(batches: Iterator[pa.RecordBatch], k: int, stretch: int) -> Iterator[tuple]:
    """(read ids, bytes, offsets, number of bytes of the first read before these, whether the last read goes on).

    Consecutive stretches of one read overlap by k + 1 bases, so that every interior k-mer stands in exactly one.
    """
    for batch in batches:
        ids, data_offsets = batch.column(0), packed.text_bytes(batch.column(1))
        data, offsets = data_offsets
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + stretch, "right")) - 1)
            if j > i + 1 or offsets[j] - offsets[i] <= stretch:
                yield ids.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], 0, False
            else:
                low, n = 0, int(offsets[j] - offsets[i])
                while True:
                    high = min(n, low + stretch + k + 1)
                    yield ids.slice(i, 1), data[offsets[i] + low : offsets[i] + high], np.array([0, high - low]), low, high < n
                    if high == n:
                        break
                    low = high - k - 1
            i = j


def placed(reads: DataFrame, k: int, targets: int, m: int | None = None, clean_only: bool = False, stretch: int = STRETCH) -> DataFrame:
    """read_id, pos, minimizer (packed into a long) and target of every interior k-mer, in one Arrow pass over the reads."""
    m = _check_lengths(k, m or sequence.minimizer_length(k))
    schema = T.StructType([T.StructField("read_id", reads.schema["read_id"].dataType), T.StructField("pos", T.IntegerType()), T.StructField("minimizer", T.LongType()), T.StructField("target", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets, before, _ in _stretches(batches, k, stretch):
            at = packed.interior(data, offsets, k, clean_only)
            read = np.searchsorted(offsets, at, "right") - 1
            found = packed.minimizers(packed.CODES[data], k, m)[at]
            columns = [ids.take(pa.array(read)), pa.array((at - offsets[read] + before).astype(np.int32)), pa.array(found.view(np.int64)), pa.array(packed.targets_of(found, m, targets))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return reads.where(F.length("seq") >= k + 2).select("read_id", "seq").mapInArrow(run, schema)


def supermers(reads: DataFrame, k: int, targets: int, m: int | None = None, clean_only: bool = False, stretch: int = STRETCH) -> DataFrame:
    """Runs of neighbouring k-mers of one target, with a base on either side: read_id, target, offset, seq.

    Built within each read in one Arrow pass: no window, no sort, no join, and a time that grows with the read's length. Reads
    hold A, C, G, T only, or else ``clean_only`` ends runs at windows that hold another letter or touch an N.
    """
    m = _check_lengths(k, m or sequence.minimizer_length(k))
    schema = T.StructType([T.StructField("read_id", reads.schema["read_id"].dataType), *[T.StructField(x, T.IntegerType()) for x in ("target", "offset")], T.StructField("seq", T.StringType())])

    def made(ids: pa.Array, targets_: np.ndarray, offset: np.ndarray, seq: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(targets_.astype(np.int32)), pa.array(offset.astype(np.int32)), seq], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None  # of a read that goes on: target, first position, bytes from the base before it
        for ids, data, offsets, before, goes_on in _stretches(batches, k, stretch):
            at = packed.interior(data, offsets, k, clean_only)
            target = packed.targets_of(packed.minimizers(packed.CODES[data], k, m)[at], m, targets)
            read = np.searchsorted(offsets, at, "right") - 1
            fresh = np.ones(len(at), bool)
            fresh[1:] = (target[1:] != target[:-1]) | (np.diff(at) != 1) | (np.diff(read) != 0)
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(at)) - 1 if len(first) else first
            if open_ is not None:
                joins = len(first) and open_[0] == target[0] and before + at[0] == open_[1] + len(open_[2]) - k - 1
                if joins:
                    # the open run ends where these bytes begin: both hold the k + 1 bases before the next position
                    seq = open_[2] + data[k + 1 : at[last[0]] + k + 1].tobytes()
                    opened = (open_[0], open_[1], seq)
                    first, last = first[1:], last[1:]
                    if not len(first) and goes_on and at[-1] + k + 1 == len(data):
                        open_ = opened
                        continue
                    open_ = opened
                yield made(ids.slice(0, 1), np.array([open_[0]]), np.array([open_[1] - 1]), pa.array([open_[2].decode("ascii", "replace")]))
                open_ = None
            if goes_on and len(first) and at[last[-1]] + k + 1 == len(data):
                a = at[first[-1]]
                open_ = (int(target[first[-1]]), int(before + a), data[a - 1 :].tobytes())
                first, last = first[:-1], last[:-1]
            start, end = at[first], at[last]
            of = read[first]
            yield made(ids.take(pa.array(of)), target[first], start - 1 - offsets[of] + before, packed.slices(data, start - 1, end - start + k + 2))

    return reads.where(F.length("seq") >= k + 2).select("read_id", "seq").mapInArrow(run, schema)


def routed(supermers_: DataFrame, loads: DataFrame | None = None, even: float = 2.0) -> DataFrame:
    """The shuffle of the pipeline: supermers at the partition of their target, with columns salt and split for hot targets.

    ``loads`` (target, load), a row for each target, tells how much each one receives: one that gets more than ``even`` times
    a partition's mean is split over several, by read and offset where the supermers have them, so that equal ones part too.
    Counts of its k-mers are partial then; ``counting.added`` adds them up.
    """
    n = int(supermers_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = {}
    if loads is not None:
        rows = loads.select("target", F.col("load").cast("double").alias("load")).collect()
        mean = sum(r.load for r in rows) / n
        salts = {r.target: math.ceil(r.load / mean) for r in rows if r.load > even * mean > 0}
    parts = F.lit(1)
    for target, salt in salts.items():
        parts = F.when(F.col("target") == target, F.lit(salt)).otherwise(parts)
    return supermers_.withColumns({"salt": F.pmod(F.xxhash64(*supermers_.columns), parts.cast("long")).cast("int"), "split": parts > 1}).repartition(n, "target", "salt")


def expanded(supermers_: DataFrame, k: int) -> DataFrame:
    """The k-mers of supermers with the bases on either side, and the supermers' other columns."""
    others = [c for c in supermers_.columns if c != "seq"]
    each = supermers_.select(*others, F.explode(F.sequence(F.lit(1), F.length("seq") - (k + 1))).alias("pos"), F.encode("seq", "UTF-8").alias("raw"))
    cut = lambda at, n: F.substring("raw", at, F.lit(n)).cast("string")
    return each.select(*others, cut(F.col("pos") + 1, k).alias("kmer"), cut(F.col("pos"), 1).alias("left"), cut(F.col("pos") + (k + 1), 1).alias("right"))
