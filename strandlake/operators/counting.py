"""Counting k-mers with votes on their neighbours, and calling extensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import BASES

#: Share of a k-mer's count that contradicting bases may not reach, and the cap of a vote.
DYNAMIC_DEPTH, VOTE_CAP = 0.9, 65_535
VOTES = [f"{side}_{b.lower()}" for side in "lr" for b in BASES]


def votes(weight: Column | None = None) -> list[Column]:
    """Eight sums: occurrences (or weights) of each base on either side."""
    one = F.lit(1).cast("long") if weight is None else weight
    zero = F.lit(0).cast("long")
    return [F.sum(F.when(F.col(c) == b, one).otherwise(zero)).alias(f"{c[0]}_{b.lower()}") for c in ("left", "right") for b in BASES]


def counted(kmers: DataFrame, *keys: str) -> DataFrame:
    """kmer, cnt and eight votes. Partial sums are made before the shuffle, so a very common k-mer costs a row per task."""
    return kmers.groupBy(*keys, "kmer").agg(F.count("*").alias("cnt"), *votes())


def added(parts: DataFrame) -> DataFrame:
    """Counts of routed supermers (by target, salt and split): those of split targets are added up, the others are whole."""
    whole = parts.where(~F.col("split")).select("kmer", "cnt", *VOTES)
    split = parts.where("split").groupBy("kmer").agg(*[F.sum(c).alias(c) for c in ("cnt", *VOTES)])
    return whole.unionByName(split)


def saturated(counts: DataFrame, cap: int = VOTE_CAP) -> DataFrame:
    """Votes that stop below the cap."""
    return counts.withColumns({v: F.least(F.col(v), F.lit(cap - 1).cast("long")) for v in VOTES})


def purged(counts: DataFrame, least: int = 2) -> DataFrame:
    """Without k-mers seen too rarely and without those that no neighbour votes for."""
    return counts.where((F.col("cnt") >= least) & (sum((F.col(v) for v in VOTES), F.lit(0)) > 0))


def plain_call(side: str) -> Column:
    """The base of most votes, the last letter of equal ones; T without votes."""
    return F.array_max(F.array(*[F.struct(F.col(f"{side}_{b.lower()}").alias("n"), F.lit(b).alias("base")) for b in BASES]))["base"]


def depth_call(side: str, depth: float = DYNAMIC_DEPTH) -> Column:
    """X if the best base has too few votes for the k-mer's count, F if a second one has enough, else the base."""
    ranked = F.sort_array(F.array(*[F.struct(F.col(f"{side}_{b.lower()}").alias("n"), F.lit(b).alias("base")) for b in BASES]), asc=False)
    least = F.greatest((F.lit(1.0 - depth) * F.col("cnt")).cast("int"), F.lit(2))
    return F.when(ranked[0]["n"] < least, "X").when(ranked[1]["n"] >= least, "F").otherwise(ranked[0]["base"])


def called(counts: DataFrame, depth: float | None = DYNAMIC_DEPTH) -> DataFrame:
    """kmer, count, left, right; plain majority if ``depth`` is None."""
    call = plain_call if depth is None else lambda side: depth_call(side, depth)
    return counts.select("kmer", F.col("cnt").alias("count"), call("l").alias("left"), call("r").alias("right"))


def unique_both_ways(calls: DataFrame, least: int = 2, cap: int = 65_535) -> DataFrame:
    """K-mers with one clear neighbour on either side; counts up to the cap."""
    return calls.where(~F.col("left").isin("X", "F") & ~F.col("right").isin("X", "F") & (F.col("count") >= least)).withColumn("count", F.least("count", F.lit(cap).cast("long")))


def target_report(placed: DataFrame, supermers: DataFrame) -> DataFrame:
    """Per target: different k-mers, their total count, supermers received. placed: kmer, cnt, target; a row for each target meets."""
    held = placed.groupBy("target").agg(F.count("*").alias("kmers"), F.sum("cnt").alias("total"))
    return held.join(supermers.groupBy("target").agg(F.count("*").alias("supermers")), "target", "full_outer")


def from_contigs(kmers: DataFrame) -> DataFrame:
    """Contig k-mers: the least depth as count, votes weighted by depth. Rows carry ``depth``."""
    return kmers.groupBy("kmer").agg(F.min("depth").alias("cnt"), *votes(F.col("depth")))


def merged(reads: DataFrame, contigs: DataFrame, depth: float = DYNAMIC_DEPTH) -> DataFrame:
    """Read counts with contig k-mers merged in.

    A contig k-mer with two bases on one side is left out; it is added where reads have none and
    replaces a read's k-mer only if that one's call is a dead end or a fork.
    """
    split = lambda side: sum((F.col(f"{side}_{b.lower()}") > 0).cast("int") for b in BASES)
    able = contigs.where((split("l") <= 1) & (split("r") <= 1)).select("kmer", *[F.col(c).alias(f"c_{c}") for c in ("cnt", *VOTES)])
    unclear = depth_call("l", depth).isin("X", "F") | depth_call("r", depth).isin("X", "F")
    both = reads.withColumn("unclear", unclear).join(able, "kmer", "full_outer")
    take = F.col("cnt").isNull() | (F.col("c_cnt").isNotNull() & F.col("unclear"))
    return both.select("kmer", *[F.when(take, F.col(f"c_{c}")).otherwise(F.col(c)).alias(c) for c in ("cnt", *VOTES)], F.when(F.col("cnt").isNull(), "added").when(take, "replaced").otherwise("kept").alias("origin"))
