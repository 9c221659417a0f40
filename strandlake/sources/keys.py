"""Keys and values for table workloads: deterministic random pairs, binary key files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digest_number(x: Column, seed: str, digits: int = 15) -> Column:
    """A number of so many hexadecimal digits from a digest: the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), x.cast("string"))), 1, digits), 16, 10).cast("long")


def random_pairs(spark: SparkSession, n: int, seed: str = "pairs", value_bits: int = 6) -> DataFrame:
    """n pseudo-random (pos, key, val); values are clipped to their bits."""
    pos = F.col("id")
    return spark.range(n).select(pos.alias("pos"), digest_number(pos, seed).alias("key"), digest_number(pos, seed + "v", 8).bitwiseAND((1 << value_bits) - 1).alias("val"))


def read_keys(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """Little-endian 64-bit keys of binary files: (file, pos, key), decoded by slices inside the JVM.

    A file is one row of Spark's binary reader, so files should be of ordinary size; each is cut into chunks of keys first.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", F.floor(F.length("content") / 8).alias("n"))
    cut = files.where("n > 0").select("file", "content", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long"))).alias("first"))
    cut = cut.select("file", "first", F.substring("content", (F.col("first") * 8 + 1).cast("int"), F.lit(chunk * 8)).alias("part"))
    each = cut.select("file", "first", "part", F.explode(F.sequence(F.lit(0), (F.length("part") / 8).cast("int") - 1)).alias("i"))
    bytes_ = F.array_join(F.reverse(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda b: F.hex(F.substring(F.col("part"), F.col("i") * 8 + b, F.lit(1))))), "")
    signed = F.conv(bytes_, 16, -10).cast("long")
    return each.select("file", (F.col("first") + F.col("i")).alias("pos"), signed.alias("key"))
