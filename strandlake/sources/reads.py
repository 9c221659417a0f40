"""Genomes and reads: text files, tables, simulation by deterministic starts. Reads are (read_id BIGINT, seq STRING)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out if the scan has fewer tasks than there are cores (one small file); large scans stay as they are."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters A, C, G, T (of either case) of each whole document, as upper-case reads."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), "text"))
    return docs.select("read_id", F.regexp_replace(F.translate("text", "acgt", "ACGT"), "[^ACGT]", "").alias("seq"))


def dirty_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters A, C, G, T, N of each whole document with their case: lower case marks low quality."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), "text"))
    return docs.select("read_id", F.regexp_replace("text", "[^ACGTNacgtn]", "").alias("seq"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as contigs with a depth."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("contig_id"), F.regexp_replace(F.translate("text", "acgt", "ACGT"), "[^ACGT]", "").alias("seq"),
        (F.lit(1) + F.col("item_id") % 7).cast("long").alias("depth"),
    )


def genome_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A genome as numbered chunks of 32 bases: (chunk, bases), from a digest of each part key."""
    parts = table(spark, sf_dir, "part")
    first = parts.agg(F.min("p_partkey")).first()[0] or 0  # keys are dense
    digits = F.md5(F.col("p_partkey").cast("string"))
    return parts.select((F.col("p_partkey") - first).alias("chunk"), F.translate(digits, "0123456789abcdef", "ACGTACGTACGTACGT").alias("bases"))


def read_genome(spark: SparkSession, path: str, strip_fasta_header: bool = False) -> DataFrame:
    """The lines of a genome file with their places: (offset BIGINT, bases STRING), to be concatenated by offset.

    Offsets come from line lengths in two steps: totals of each scan task (a row per task reaches
    the driver), then running sums within a task; no task sees the whole genome.
    """
    lines = spark.read.text(path).select(F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("bases"))
    if strip_fasta_header:
        lines = lines.where(~F.col("bases").startswith(">"))
    totals = sorted((r.task, r.n) for r in lines.groupBy("task").agg(F.sum(F.length("bases")).alias("n")).collect())
    before, at = [], 0
    for task, n in totals:
        before.append((task, at))
        at += n
    starts = spark.createDataFrame(before or [(0, 0)], "task int, start long")
    running = F.sum(F.length("bases")).over(W.partitionBy("task").orderBy("line"))
    return lines.withColumn("end", running).join(F.broadcast(starts), "task").select((F.col("start") + F.col("end") - F.length("bases")).alias("offset"), "bases")


def share_of(total: Column, targets: Column, rank: Column) -> tuple[Column, Column]:
    """(start, size) of a rank's contiguous share, the first ranks holding one more where it doesn't divide."""
    each, over = F.floor(total / targets), total % targets
    return (rank * each + F.least(rank, over)).cast("long"), (each + F.when(rank < over, 1).otherwise(0)).cast("long")


def partitions(spark: SparkSession, genome_length: int, n_reads: int, targets: int) -> DataFrame:
    """(target, start, portion, n_reads) of each target's part of a genome and of its quota of reads."""
    rank, n = F.col("id"), F.lit(targets)
    start, portion = share_of(F.lit(genome_length), n, rank)
    return spark.range(targets).select(rank.cast("int").alias("target"), start.alias("start"), portion.alias("portion"), share_of(F.lit(n_reads), n, rank)[1].alias("n_reads"))


def cut_reads(chunks: DataFrame, starts: DataFrame, read_length: int, chunk_length: int = 32) -> DataFrame:
    """Reads of a fixed length from a genome in equal chunks: starts are (read_id, start).

    Each read asks for the few chunks that it spans by an equi-join, so the genome is never one row.
    """
    asked = starts.select(
        "read_id", "start", F.explode(F.sequence(F.floor(F.col("start") / chunk_length), F.floor((F.col("start") + read_length - 1) / chunk_length))).alias("chunk")
    )
    got = asked.join(chunks, "chunk").groupBy("read_id", "start").agg(F.sort_array(F.collect_list(F.struct("chunk", "bases"))).alias("parts"))
    whole = F.array_join(F.col("parts.bases"), "")
    return got.select("read_id", "start", F.substring(whole, (F.col("start") % chunk_length + 1).cast("int"), F.lit(read_length)).alias("seq"))


def fastq_like(df: DataFrame, seq_col: str, quality_col: str, least: int = 20, offset: int = 33) -> DataFrame:
    """Lower-cases bases whose Phred quality is below ``least``."""
    pairs = F.zip_with(F.split(seq_col, ""), F.split(quality_col, ""), lambda b, q: F.when(F.ascii(q) - offset < least, F.lower(b)).otherwise(b))
    return df.withColumn(seq_col, F.array_join(pairs, ""))


def chunked(lines: DataFrame, chunk_length: int = 32) -> DataFrame:
    """The genome of ``read_genome`` in numbered chunks of equal length (the last may be shorter), as ``cut_reads`` takes it.

    A line gives each chunk that it touches its piece; a chunk gathers the pieces of its own length only.
    """
    size, end = F.lit(chunk_length).cast("long"), F.col("offset") + F.length("bases")
    touched = lines.where(F.length("bases") > 0).select("offset", "bases", F.explode(F.sequence(F.expr(f"offset div {chunk_length}"), F.floor((end - 1) / chunk_length))).alias("chunk"))
    first = F.greatest(F.col("offset"), F.col("chunk") * size)
    last = F.least(end, (F.col("chunk") + 1) * size)
    pieces = touched.select("chunk", first.alias("at"), F.substring("bases", (first - F.col("offset") + 1).cast("int"), (last - first).cast("int")).alias("piece"))
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("at", "piece")))["piece"], "")
    return pieces.groupBy("chunk").agg(joined.alias("bases"))


def rank_starts(spark: SparkSession, genome_length: int, n_reads: int, read_length: int, targets: int) -> DataFrame:
    """(read_id, target, start): reads numbered through, each target's quota starting within its own part of the genome.

    The place comes from a digest of target and number, so a read is the same on every run and in any engine that has md5.
    """
    if n_reads and genome_length // targets < read_length:
        raise ValueError("a read is longer than a target's part of the genome")
    each, over = divmod(n_reads, targets)
    edge, i = over * (each + 1), F.col("id")
    target = F.when(i < edge, F.expr(f"id div {each + 1}")).otherwise(F.lit(over) + F.expr(f"(id - {edge}) div {max(each, 1)}"))
    start, portion = share_of(F.lit(genome_length), F.lit(targets), F.col("target"))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("target").cast("string"), F.col("read_id").cast("string"))), 1, 12), 16, 10).cast("long")
    numbered = spark.range(n_reads).select(i.alias("read_id"), target.cast("int").alias("target"))
    return numbered.select("read_id", "target", (start + digest % (portion - read_length + 1)).cast("long").alias("start"))
