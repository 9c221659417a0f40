"""Streaming counts against the batch operators."""

from strandlake.operators import counting, kmers
from strandlake.sources.reads import text_reads
from strandlake.streaming import counter

SF = "/root/testdata/sf0.001"


def test_running_counts_equal_batch(spark, tmp_path):
    reads = text_reads(spark, SF)
    for i, part in enumerate(reads.randomSplit([1.0, 1.0], seed=1)):
        part.write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in/*")
    q = counter.running_counts(stream, 21).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted(map(tuple, df.select("kmer", "cnt", *counting.VOTES).collect()))
    assert rows(spark.table("running")) == rows(counting.counted(kmers.canonical_kmers(reads, 21)))


def test_windows_leave_the_state(spark, tmp_path):
    rows = [(1, "ACGTAC", "2024-01-01 00:00:10"), (2, "ACGT", "2024-01-01 00:00:50"), (3, "GGGG", "2024-01-01 00:30:00"), (4, "TTTT", "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "read_id long, seq string, ts string").selectExpr("read_id", "seq", "to_timestamp(ts) as ts")
    for i in range(4):
        df.where(f"read_id = {i + 1}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = counter.windowed_counts(stream, 4, "10 minutes", "5 minutes").writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r.window.start)[11:16], r.kmer): r.cnt for r in spark.table("windows").collect()}
    assert got == {("00:00", "ACGT"): 2, ("00:00", "CGTA"): 1, ("00:00", "GTAC"): 1, ("00:30", "GGGG"): 1}
