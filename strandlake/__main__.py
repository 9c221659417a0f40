"""python -m strandlake GENOME READS READ_LENGTH K [FOLDER]: simulates reads of a genome file, counts their k-mers, reports each target.

FOLDER takes a record of the time, appended. The session comes from spark-submit or is a local one.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import counting, kmers
from .sources import reads, sinks


def simulate(spark: SparkSession, genome: str, n_reads: int, read_length: int, targets: int) -> DataFrame:
    """Reads of the genome file, each target's within its own part."""
    lines = reads.read_genome(spark, genome)
    length = lines.agg(F.max(F.col("offset") + F.length("bases"))).first()[0] or 0
    return reads.cut_reads(reads.chunked(lines), reads.rank_starts(spark, length, n_reads, read_length, targets).select("read_id", "start"), read_length)


def summary(simulated: DataFrame, k: int, targets: int, m: int | None = None) -> DataFrame:
    """Per target: different k-mers, their total count, and the supermers it receives."""
    runs = kmers.supermers(simulated, k, targets, m)
    # counted by k-mer first: the target follows from the k-mer, so it is found once for each
    counts = kmers.interior_kmers(simulated, k).groupBy("kmer").agg(F.count("*").alias("cnt"))
    return counting.target_report(kmers.with_target(counts, k, targets, m), runs)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandlake")
    parser.add_argument("genome")
    parser.add_argument("reads", type=int)
    parser.add_argument("read_length", type=int)
    parser.add_argument("k", type=int)
    parser.add_argument("folder", nargs="?")
    parser.add_argument("--targets", type=int, default=8)
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName("strandlake").getOrCreate()
    simulated = simulate(spark, given.genome, given.reads, given.read_length, given.targets)
    start = time.perf_counter()
    counts = counting.counted(kmers.canonical_kmers(simulated, given.k))
    counting.unique_both_ways(counting.called(counting.purged(counts))).write.format("noop").mode("overwrite").save()
    took = (time.perf_counter() - start) * 1000
    for r in summary(simulated, given.k, given.targets).orderBy("target").collect():  # a row for each target
        print(f"target {r.target}: {r.kmers} k-mers, total count {r.total}, {r.supermers} supermers")
    print(f"counting time: {took:.0f} ms")
    if given.folder:
        sinks.append_timing(spark, given.folder, given.reads, given.read_length, given.k, took)


if __name__ == "__main__":
    main()
