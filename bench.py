"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
HEADLINES = ["kmer_uu_table", "kmer_counts_forward", "kmer_uu_masked", "supermers", "supermer_load", "minimizer", "contig_merge", "simulated_kmer_counts", "kv_lookup", "kv_toggle"]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from strandlake.plans import registry

    def timed(name: str, path: str) -> float:
        start = time.perf_counter()
        registry.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    small = os.path.join(os.path.dirname(os.path.normpath(sf_dir)), "sf0.001")
    for name in HEADLINES:  # compiled once, as in any running session
        timed(name, small if os.path.isdir(small) else sf_dir)
    took = {name: timed(name, sf_dir) for name in HEADLINES}
    from strandlake.operators import kmers
    from strandlake.sources import reads

    n = kmers.interior_kmers(reads.text_reads(spark, sf_dir), 21).count()
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"), "kmer_occurrences": n, "occurrences_per_second": round(n / took["kmer_uu_table"]),
    }))


if __name__ == "__main__":
    main()
