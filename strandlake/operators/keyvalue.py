"""Keyed tables: what hash tables and membership filters do, as set operations on (key, val)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashes


def append(pairs: DataFrame, more: DataFrame) -> DataFrame:
    """Multiset insert: no test for duplicates. A missing val is 0."""
    more = more if "val" in more.columns else more.withColumn("val", F.lit(0).cast("long"))
    return pairs.select("key", "val").unionByName(more.select("key", "val"))


def insert_if_absent(pairs: DataFrame, more: DataFrame) -> DataFrame:
    """The first value of a key stays; ``more`` has an order in ``seq``."""
    fresh = more.groupBy("key").agg(F.min(F.struct("seq", "val"))["val"].alias("val"))
    return pairs.select("key", "val").unionByName(fresh.join(pairs.select("key").distinct(), "key", "left_anti").select("key", "val"))


def insert_or_get(pairs: DataFrame, more: DataFrame) -> DataFrame:
    """What each insert of ``more`` (key, seq, val) finds: key, seq, found, existing (the value that stays; null if it inserts).

    The inserts of one key come in the order of ``seq``, which no two of them share; the first of an absent key inserts, the others find its value. A key
    is met by its first insert, not by a window over all of them, so a hot key costs no task of its own.
    """
    firsts = more.groupBy("key").agg(F.min(F.struct("seq", "val")).alias("first"))
    held = pairs.groupBy("key").agg(F.min("val").alias("held"))
    known = firsts.join(held, "key", "left")
    got = more.select("key", "seq").join(known, "key")
    found = F.col("held").isNotNull() | (F.col("seq") > F.col("first.seq"))
    return got.select("key", "seq", found.alias("found"), F.when(found, F.coalesce("held", "first.val")).alias("existing"))


def first_wins(events: DataFrame) -> DataFrame:
    return events.groupBy("key").agg(F.min(F.struct("seq", "val"))["val"].alias("val"))


def last_wins(events: DataFrame) -> DataFrame:
    return events.groupBy("key").agg(F.max(F.struct("seq", "val"))["val"].alias("val"))


def toggled(events: DataFrame) -> DataFrame:
    """Each event removes the key if it is there and inserts it if not: keys of an odd number stay, with their last value."""
    return events.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("seq", "val"))["val"].alias("val")).where(F.col("n") % 2 == 1).select("key", "val")


def toggle_log(events: DataFrame) -> DataFrame:
    """What each event did: found (and so removed) or inserted."""
    n = F.row_number().over(W.partitionBy("key").orderBy("seq"))
    return events.withColumn("found", n % 2 == 0)


def lookup(pairs: DataFrame, probes: DataFrame, default: Column | None = None) -> DataFrame:
    """Each probe with its value, or the default (null) where the key is missing."""
    got = probes.join(pairs.select("key", "val"), "key", "left").withColumn("found", F.col("val").isNotNull())
    return got if default is None else got.withColumn("val", F.coalesce("val", default))


def present(pairs: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(pairs.select("key"), "key", "left_semi")


def missing(pairs: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(pairs.select("key"), "key", "left_anti")


def remove_one(pairs: DataFrame, gone: DataFrame) -> DataFrame:
    """Multiset subtraction: a removal takes one pair of its key, those of the smallest values first.

    Counts of removals per key decide by rank within the key.
    """
    times = gone.groupBy("key").agg(F.count("*").alias("times"))
    ranked = pairs.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("val")))
    return ranked.join(times, "key", "left").where(F.col("n") > F.coalesce("times", F.lit(0))).select("key", "val")


def fill(pairs: DataFrame, slots: int) -> DataFrame:
    return pairs.agg(F.count("*").alias("live"), F.countDistinct("key").alias("keys")).select("live", "keys", F.lit(slots).cast("long").alias("slots"), (F.col("live") / slots).alias("load"))


def distinct_keys(pairs: DataFrame) -> DataFrame:
    return pairs.select("key").distinct()


def counted_keys(events: DataFrame, cap: int) -> DataFrame:
    """A counting map whose counts stop at the cap."""
    return events.groupBy("key").agg(F.least(F.count("*"), F.lit(cap).cast("long")).alias("cnt"))


def tag(hash_value: Column, bits: int) -> Column:
    """The low bits of a hash as a tag; the two reserved values move by one."""
    low = hash_value.bitwiseAND((1 << bits) - 1)
    return F.when(low == 0, F.lit(1)).when(low == (1 << bits) - 1, F.lit((1 << bits) - 2)).otherwise(low)


def tag_collisions(keys: DataFrame, hash_value: Column, bits: int, buckets: int) -> DataFrame:
    """Per tag width: keys that share bucket and tag with another key, the source of false positives."""
    placed = keys.select((F.shiftright(hash_value, bits) % buckets).alias("bucket"), tag(hash_value, bits).alias("tag")).groupBy("bucket", "tag").agg(F.count("*").alias("n"))
    return placed.agg(F.sum("n").alias("keys"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("colliding"), F.max("n").alias("largest"))


def batch_report(pairs: DataFrame, probes: DataFrame, batches: int) -> DataFrame:
    """Per batch of inserted keys: hits, right values, and hits of keys that were never inserted.

    pairs: key, val, batch; probes: key, batch of keys that may be absent.
    """
    values = pairs.groupBy("key").agg(F.min("val").alias("stored"))
    own = pairs.join(values, "key", "left").groupBy("batch").agg(F.count("*").alias("inserted"), F.count("stored").alias("found"), F.count_if(F.col("stored") == F.col("val")).alias("right_value"))
    other = probes.join(values, "key", "left").groupBy("batch").agg(F.count("*").alias("probed"), F.count("stored").alias("hits"))
    return own.join(other, "batch", "full_outer").where((F.col("batch") >= 0) & (F.col("batch") < batches))


def bounded_filter(pairs: DataFrame, buckets: int, bucket_size: int, tag_bits: int, shards: int, seed: int = 1) -> DataFrame:
    """Simulates a two-choice filter of fixed size: per shard, keys tried, kept, and the place of the first one refused.

    A key goes to the first of its two buckets while that is less than three quarters full, else to the emptier one, and is
    refused when both are full. pairs: key, seq. Shards are independent tables and groups of their own, so a shard is a task's work.
    """
    schema = "shard int, tried long, kept long, first_refused long"

    def simulate(shard: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        h = hashes.murmur2_array(pdf["key"].to_numpy(np.int64).view(np.uint64)[:, None], seed)
        low = h & np.uint64((1 << tag_bits) - 1)
        first = ((h >> np.uint64(tag_bits)) % np.uint64(buckets)).astype(int)
        second = (((h >> np.uint64(tag_bits)) ^ (low * np.uint64(0x5BD1E995))) % np.uint64(buckets)).astype(int)
        full, kept, refused = [0] * buckets, 0, -1
        for i, (a, b) in enumerate(zip(first.tolist(), second.tolist(), strict=True)):
            at = a if full[a] * 4 < bucket_size * 3 or full[a] <= full[b] else b
            if full[at] < bucket_size:
                full[at] += 1
                kept += 1
            elif refused < 0:
                refused = i
        return pd.DataFrame({"shard": [shard[0]], "tried": [len(pdf)], "kept": [kept], "first_refused": [refused]})

    return pairs.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(simulate, schema)


def owner(key: Column, targets: int) -> Column:
    """The partition that owns a text key, by a digest both engines have."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % targets


def neighbours_agree(pairs: DataFrame, ranks: int) -> DataFrame:
    """Per rank: how many keys of the next rank it finds with the right value. pairs: rank, i, key, val."""
    asked = pairs.select(((F.col("rank") + (ranks - 1)) % ranks).alias("asker"), F.col("key"), F.col("key").alias("expected"))
    got = asked.join(pairs.select("key", "val"), "key", "left")
    return got.groupBy(F.col("asker").alias("rank")).agg(F.count("*").alias("asked"), F.count_if(F.coalesce("val", F.lit("")) == F.col("expected")).alias("agreeing"))
