"""Tables of bounded size, replayed event by event: which bucket takes a key, what is found, removed or refused."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashes

OPS = ("insert", "insert_or_get", "toggle", "query", "remove")


@dataclass(frozen=True)
class Shape:
    """Sizes and rules of a table.

    choose: ``shortcut`` (the first candidate bucket that is less than three quarters full, else the emptiest), ``least`` (the
    emptiest) or ``first`` (the first with room, in probe order). The first two have as candidates a bucket and its tag partner;
    ``first`` probes neighbours. With ``tag_bits`` 0 whole keys are kept, else tags, and another key of the same tag and bucket
    is taken for its own. Slots of removed keys take new ones if ``reuse``. ``backing`` buckets, probed one after the other,
    take what the main table refuses.
    """

    buckets: int
    bucket_size: int = 16
    choose: str = "shortcut"
    probes: int = 20
    tag_bits: int = 10
    reuse: bool = True
    backing: int = 0
    backing_probes: int = 4000
    seed: int = 1

    def __post_init__(self) -> None:
        if self.choose not in ("shortcut", "least", "first"):
            raise ValueError("choose is shortcut, least or first")
        if self.choose != "first" and not self.tag_bits:
            raise ValueError("the partner of a bucket comes from a tag")


class _Level:
    """Buckets of slots (mark, val); a removed slot is None and no longer empty."""

    def __init__(self, buckets: int, shape: Shape, stop: str) -> None:
        self.held: list[list] = [[] for _ in range(buckets)]
        self.size, self.reuse, self.stop = shape.bucket_size, shape.reuse, stop

    def live(self, bucket: int) -> int:
        slots = self.held[bucket]
        return len(slots) - slots.count(None)

    def put(self, bucket: int, mark: int, val: int) -> bool:
        slots = self.held[bucket]
        if self.reuse and None in slots:
            slots[slots.index(None)] = (mark, val)
        elif len(slots) < self.size:
            slots.append((mark, val))
        else:
            return False
        return True

    def find(self, places: list[int], mark: int) -> tuple[int, int] | None:
        for b in places:
            for i, slot in enumerate(self.held[b]):
                if slot is not None and slot[0] == mark:
                    return b, i
            # a search by neighbours ends where an insert would have ended
            if (self.stop == "empty" and len(self.held[b]) < self.size) or (self.stop == "live" and self.live(b) < self.size):
                return None
        return None

    def order(self, places: list[int], choose: str) -> list[int]:
        if choose == "first":
            return places
        fills = {b: self.live(b) for b in places}
        easy = [b for b in places if choose == "shortcut" and fills[b] * 4 < self.size * 3]
        return easy + sorted((b for b in places if b not in easy), key=fills.__getitem__)


class _Table:
    def __init__(self, shape: Shape) -> None:
        self.shape = shape
        self.levels = [_Level(shape.buckets, shape, "empty" if shape.choose == "first" else "never")]
        if shape.backing:
            self.levels.append(_Level(shape.backing, shape, "live"))

    def _asked(self, key: int, h: int) -> list[tuple[_Level, list[int], int, str]]:
        """Of each level: candidate buckets, what a slot keeps of the key, and how a bucket is chosen."""
        s = self.shape
        tag, mark = h & ((1 << s.tag_bits) - 1), key
        if s.tag_bits:
            mark = tag = 1 if tag == 0 else (1 << s.tag_bits) - 2 if tag == (1 << s.tag_bits) - 1 else tag
        at = h >> s.tag_bits
        near = lambda start, n, buckets: [(start + i) % buckets for i in range(min(n, buckets))]
        main = near(at, s.probes, s.buckets) if s.choose == "first" else list(dict.fromkeys([at % s.buckets, (at ^ tag) % s.buckets]))
        out = [(self.levels[0], main, mark, s.choose)]
        if s.backing:
            out.append((self.levels[1], near(h, s.backing_probes, s.backing), mark, "first"))
        return out

    def apply(self, op: str, key: int, h: int, val: int) -> tuple[bool, bool, int | None]:
        """(done, found, value found)."""
        asked = self._asked(key, h)
        if op != "insert":
            for level, places, mark, _ in asked:
                where = level.find(places, mark)
                if where is not None:
                    b, i = where
                    got = level.held[b][i][1]
                    if op in ("remove", "toggle"):
                        level.held[b][i] = None
                    return True, True, got
            if op in ("query", "remove"):
                return False, False, None
        return any(level.put(b, mark, val) for level, places, mark, choose in asked for b in level.order(places, choose)), False, None


def replayed(events: DataFrame, shape: Shape, shards: int) -> DataFrame:
    """What each event does: key, seq, op, done, found, got (the value found).

    events: key, seq, op, val, where op is one of OPS; those of a shard are applied in the order of seq (ties: key, op, val). An
    insert that finds no room is not done; a query or removal is done if the key is found. Shards are tables of their own, by the
    hash of the key; each is the work of one task that holds its events, so ``shards`` is to grow with them. Null keys, sequence
    numbers or operations take no part, a null val is 0, an empty table gives an empty result.
    """
    schema = "key long, seq long, op string, done boolean, found boolean, got long"

    def replay(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "key", "op", "val"])
        table = _Table(shape)
        h = hashes.murmur2_array(pdf["key"].to_numpy(np.int64).view(np.uint64)[:, None], shape.seed)
        rows = zip(pdf["op"], pdf["key"].tolist(), h.tolist(), pdf["val"].tolist(), strict=True)
        done, found, got = zip(*(table.apply(*row) for row in rows), strict=True)
        return pdf[["key", "seq", "op"]].assign(done=done, found=found, got=pd.array(got, dtype="Int64"))

    known = events.where(F.col("key").isNotNull() & F.col("seq").isNotNull() & F.col("op").isin(*OPS))
    known = known.select("key", "seq", "op", F.coalesce("val", F.lit(0)).cast("long").alias("val"))
    return known.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(replay, schema)


def outcomes(replayed_: DataFrame, *by: str) -> DataFrame:
    """Per operation (and what else is asked for): events, those done, those that found their key."""
    return replayed_.groupBy(*by, "op").agg(F.count("*").alias("events"), F.count_if("done").alias("done"), F.count_if("found").alias("found"))
