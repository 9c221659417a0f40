"""K-mer counts of a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import counting, kmers


def running_counts(reads: DataFrame, k: int) -> DataFrame:
    """Counts and votes of canonical k-mers over all reads so far; start it in complete or update mode.

    The state holds a row for each distinct k-mer; partial sums are made before the shuffle, as in batch.
    """
    return counting.counted(kmers.canonical_kmers(reads, k))


def windowed_counts(reads: DataFrame, k: int, window: str, late: str, time_col: str = "ts") -> DataFrame:
    """Counts per event-time window; the watermark lets windows leave the state, so it stays bounded."""
    timed = reads.withWatermark(time_col, late).select(F.window(time_col, window).alias("window"), F.col("read_id"), F.col("seq"))
    each = timed.where(F.length("seq") >= k).select("window", F.explode(F.sequence(F.lit(1), F.length("seq") - (k - 1))).alias("pos"), F.encode("seq", "UTF-8").alias("raw"))
    return each.groupBy("window", F.substring("raw", F.col("pos"), F.lit(k)).cast("string").alias("kmer")).agg(F.count("*").alias("cnt"))


def toggle_events(events: DataFrame) -> DataFrame:
    """A stateful filter: keys seen an odd number of times so far, as running parity. events: key, val."""
    return events.groupBy("key").agg(F.count("*").alias("n"), F.last("val").alias("val")).withColumn("present", F.col("n") % 2 == 1)
