"""Result sinks: appended timing records, throughput series, k-mer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TIMING_SCHEMA = "`Num reads` long, `Read len` int, `Kmer len` int, `DHT time` double"


def append_timing(spark: SparkSession, path: str, n_reads: int, read_length: int, k: int, milliseconds: float) -> None:
    """Appends one record; every part file has the header, so the folder reads as one table."""
    row = spark.createDataFrame([(n_reads, read_length, k, float(milliseconds))], TIMING_SCHEMA)
    row.coalesce(1).write.mode("append").option("header", True).csv(path)


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMING_SCHEMA).option("header", True).csv(path)


def write_series(df: DataFrame, path: str) -> None:
    """Series of numbers, separated by a space, without a header."""
    df.write.mode("overwrite").option("sep", " ").csv(path)


def write_kmers(counts: DataFrame, path: str, buckets: int = 64) -> None:
    """A k-mer result (kmer, count, left, right) by hash of the k-mer, so that later joins on it read one file set each."""
    counts.repartition(buckets, "kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(path)
