"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

1. One pass over the texts: distinct 5-word shingles, a sketch, one key for each band. Equal sets
   form a class (64-bit hash of the set); all later steps work on classes.
2. Bands that hold two classes or more are found by a pre-aggregated minimum and maximum, so a
   band shared by very many documents costs one row for each map task.
3. The centre of a band is the class that meets most others over all its bands. Each class is verified
   against two centres: the widest one, and the one that it shares most bands with. Links become components;
   this joins most of any large group of copies by twice as many comparisons as it has members.
4. What remains are pairs of one band in different components. Shingles held by one candidate only
   can't be shared: of two classes with u and u' shingles held elsewhere no more than min(u, u') are common.
   If both were tested against the same centre, no more than they both share with it (a bit for each of its
   shingles says which) plus the smaller number held elsewhere outside it. These exact bounds leave few pairs; in each band the members
   outside the band's largest component meet the rest, and what the bounds allow is verified.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .graph import components
from .sketches import band_keys, mix, shingle_sets, sketch
from .words import rows

BAND_ROWS = 6
BANDS = 60  # a pair at similarity 0.75 shares a band with probability 1 - (1 - 0.75^6)^60 > 0.99999


def _sketched(batches: Iterator[pa.RecordBatch], bands: int, band_rows: int) -> Iterator[pa.RecordBatch]:
    """(id, text, text key) -> (id, text key, n_shingles, class, bands)."""
    kind = None
    keys: list = []

    def typed():
        nonlocal kind
        for b in batches:
            kind = b.schema.field(0).type
            keys.extend(b.column(2).to_pylist())
            yield b

    for ids, texts in rows(typed()):
        sets = shingle_sets(texts)
        own, keys[: len(ids)] = keys[: len(ids)], []
        classes = [int(_class_of(s)) if len(s) else None for s in sets]
        found = [band_keys(sketch(s, bands * band_rows), band_rows).view(np.int64) if len(s) else [] for s in sets]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), pa.array(own, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
            names=["id", "k", "n", "c", "bands"],
        )


def _class_of(items: np.ndarray) -> np.int64:
    at = np.arange(1, len(items) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(np.bitwise_xor.reduce(mix(items + at))[None] + np.uint64(len(items))).view(np.int64)[0]


def _as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, text) -> (class, n, items as binary)."""
    for ids, texts in rows(batches):
        sets = shingle_sets(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["c", "n", "items"]
        )


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c, items in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            s = np.frombuffer(items.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), c))], names=["h", "c"])


def _bits(marks: np.ndarray) -> np.ndarray:
    return np.packbits(np.concatenate([marks, np.zeros(-len(marks) % 64, bool)]), bitorder="little").view(np.int64)


def _linked(batches: Iterator[pa.RecordBatch], percent: int, with_bits: bool) -> Iterator[pa.RecordBatch]:
    """(a, b, items of a, items of b) -> (a, b, size of the intersection, is a link, which items of a are shared, which of b)."""
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch, out = whole.slice(start, 256), []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                marks = y[np.minimum(at, len(y) - 1)] == x
                same = int(marks.sum())
                linked = 100 * same >= percent * (len(x) + len(y) - same)
                if with_bits:
                    others = np.zeros(len(y), bool)
                    others[at[marks]] = True
                    out.append((same, linked, _bits(marks), _bits(others)))
                else:
                    out.append((same, linked, None, None))
            kinds = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "shared", "linked", "in_a", "in_b"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int, with_bits: bool = False) -> DataFrame:
    """The pairs (a, b) of classes with the shingles they share and whether they are links, from the full sets."""
    one = lambda k: sets.select(F.col("c").alias(k), F.col("items").alias(f"items_{k}"))
    joined = pairs.hint("merge").join(one("b").hint("merge"), "b").hint("merge").join(one("a").hint("merge"), "a")
    return joined.select("a", "b", "items_a", "items_b").mapInArrow(lambda it: _linked(it, percent, with_bits), "a long, b long, shared long, linked boolean, in_a array<long>, in_b array<long>")


def _released(spark) -> None:
    """Lets Spark drop shuffle files of finished steps now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """Components of documents linked by 5-word shingle similarity of percent/100 or more.

    Returns a row for each input row: the id, n_shingles, component_id (the least id reachable) and
    kept (id = component_id). A null or empty text has no shingles and is linked with nothing. Rows
    with equal sets are linked, repeated rows too; a null id is never the least one unless there is no
    other, and is not kept then. An empty table gives an empty result; other columns are not read.
    """
    with common.Scratch(docs.sparkSession) as scratch:
        rows_, classes = _labelled(docs, id_col, text_col, percent, bands, band_rows, scratch)
        out = rows_.join(classes.hint("merge"), "c", "left")
        component = F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component"))
        out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
        return scratch.kept(out, "components")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the least id.

    Texts without words are kept, but repeated rows of them, and repeated rows of the least id, count as one. Null ids
    come last: such a row stays only where its group has no other. Further columns may have any names, even those of
    id and text in another case; an empty table gives an empty result.
    """
    names = docs.columns
    columns = [f"_{i}" for i in range(len(names))]
    id_, text = (F.col(columns[names.index(c)]) for c in (id_col, text_col))
    keyed = docs.toDF(*columns).withColumns({"id": id_, "k": _key(text)})
    with common.Scratch(docs.sparkSession) as scratch:
        rows_, classes = _labelled(docs, id_col, text_col, percent, bands, band_rows, scratch)
        out = rows_.join(classes.hint("merge"), "c", "left").where("c is null or id <=> component").groupBy("id", "k").agg(F.count("*").alias("times"), F.min("c").alias("c"), F.first("label").alias("label"))
        out = scratch.table(out, "least")
        # equal ids with different texts in one component: the least text key stays
        first = out.where("c is not null").groupBy("label").agg(F.min("k").alias("k"))
        first = out.where("c is not null").join(first, ["label", "k"]).select("id", "k", "times")
        kept = scratch.kept(first.unionByName(out.where("c is null").select("id", "k", "times")), "kept")
    match = lambda k: keyed["id"].eqNullSafe(k["id"]) & (keyed["k"] == k["k"])
    single, repeated = kept.where("times = 1"), kept.where("times > 1")
    out = keyed.join(single, match(single), "left_semi").unionByName(keyed.join(repeated, match(repeated), "left_semi").dropDuplicates(["id", "k"]))
    return out.select(*columns).toDF(*names)


def _key(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _labelled(docs: DataFrame, id_col: str, text_col: str, percent: int, bands: int, band_rows: int, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, k, n, c) of each row, and (c, label, component) of each class; a component is its least id."""
    spark = docs.sparkSession
    docs = common.pick(docs, id_col, text_col).toDF("id", "text").withColumn("k", _key(F.col("text")))
    paths: list[str] = []

    def written(df: DataFrame, tag: str) -> DataFrame:
        """Materialised until the classes are known."""
        table, path = common.materialise(df, tag)
        paths.append(path)
        return table

    id_type = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), *[T.StructField(x, T.LongType()) for x in ("k", "n", "c")], T.StructField("bands", T.ArrayType(T.LongType()))])
    sketched = scratch.table(docs.mapInArrow(lambda it: _sketched(it, bands, band_rows), schema), "sketches")

    # bands with two classes or more, and their members
    in_bands = sketched.select(F.explode("bands").alias("band"), "c")
    shared = in_bands.groupBy("band").agg(F.min("c").alias("first"), F.max("c").alias("last"), F.count("*").alias("size")).where("first <> last").select("band", "size")
    members = written(in_bands.hint("merge").join(shared.hint("merge"), "band").distinct(), "members")
    _released(spark)

    # the sets of candidate classes, from one text of each
    wanted = members.select("c").distinct().join(sketched.groupBy("c").agg(F.min("k").alias("k")), "c")
    texts = docs.select("k", "text").join(wanted, "k").select("c", "text")
    sets = texts.mapInArrow(_as_sets, "c long, n long, items binary")
    sets = written(sets.groupBy("c").agg(F.first("n").alias("n"), F.first("items").alias("items")), "sets")
    _released(spark)

    # each class against two centres: the widest known, and the one that it shares most bands with
    hubs = members.groupBy("c").agg(F.sum("size").alias("hub"))
    centres = members.select("band", "c").join(hubs, "c").groupBy("band").agg(F.max(F.struct("hub", "c")).alias("x")).select("band", F.col("x.hub").alias("hub"), F.col("x.c").alias("centre"))
    shares = members.select("band", "c").join(centres, "band").where("c <> centre").groupBy("c", "centre").agg(F.count("*").alias("n"), F.first("hub").alias("hub"))
    best = shares.groupBy("c").agg(F.max(F.struct("hub", "centre")).alias("x"), F.max(F.struct("n", "hub", "centre")).alias("y"))
    best = written(best.select("c", "x", F.col("y.centre").alias("y")), "centres")
    pairs = best.select(F.explode(F.array_distinct(F.array("x.centre", "y"))).alias("o"), "c").select(F.least("o", "c").alias("a"), F.greatest("o", "c").alias("b")).distinct()
    tested = written(verified(pairs, sets, percent, True), "tested")
    links = tested.where("linked").select("a", "b")
    label = written(components(links, paths), "labels")

    # the rest: members of one band in different components that the bound allows
    alone = sets.select("c", "items").mapInArrow(_exploded, "h long, c long").groupBy("h").agg(F.count("*").alias("x"), F.min("c").alias("c")).where("x = 1")
    alone = alone.groupBy("c").agg(F.count("*").alias("alone"))
    own = best.join(hubs, "c").select("c", F.when(F.col("x") > F.struct("hub", F.col("c").alias("centre")), F.col("x.centre")).otherwise(F.col("c")).alias("centre"))
    own = own.withColumns({"a": F.least("c", "centre"), "b": F.greatest("c", "centre")}).join(tested, ["a", "b"], "left")
    own = own.select("c", "centre", "shared", F.when(F.col("centre") == F.col("a"), F.col("in_a")).otherwise(F.col("in_b")).alias("bits"))
    facts = (
        sets.select("c", "n").join(alone, "c", "left").join(label.withColumnRenamed("node", "c"), "c", "left").join(own, "c", "left")
        .select(
            "c", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("u"), F.coalesce("label", "c").alias("label"),
            F.coalesce("centre", "c").alias("centre"), F.coalesce("shared", "n").alias("shared"), "bits",
        )
        .where(100 * F.col("u") >= percent * F.col("n"))
    )
    placed = written(members.select("band", "c").join(facts, "c"), "placed")
    _released(spark)
    per_label = placed.groupBy("band", "label").count()
    mixed = per_label.groupBy("band").agg(F.max(F.struct("count", "label")).alias("x"), F.count("*").alias("labels")).where("labels > 1").select("band", F.col("x.label").alias("major"))
    minor = placed.join(mixed, "band").where("label <> major").select("band", *[F.col(x).alias(f"{x}2") for x in ("c", "n", "u", "label", "centre", "shared", "bits")])
    # sizes of a linked pair differ by a factor of 100 / percent at most: neighbouring classes of size, so a band isn't met as a whole.
    # Both sides are written first: each can then be split where a band is hot.
    size = lambda n: F.floor(F.log(F.col(n)) / math.log(100.0 / percent * 1.0001)).cast("long")
    minor = written(minor.withColumn("size", F.explode(F.array(*[size("n2") + d for d in (-1, 0, 1)]))), "minor")
    placed = placed.withColumn("size", size("n"))
    # at most so many shingles in common: those in the common centre, and of the others those held elsewhere
    outside = lambda k: F.greatest(F.col(f"u{k}") - F.col(f"shared{k}"), F.lit(0))
    beside = F.least(outside(""), outside("2"))
    same_centre = F.col("centre") == F.col("centre2")
    in_centre = F.aggregate(F.zip_with("bits", "bits2", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    enough = lambda most: 100 * most >= percent * (F.col("n") + F.col("n2") - most)
    rough = F.least("u", "u2")
    rough = F.when(same_centre, F.least(rough, F.least("shared", "shared2") + beside)).otherwise(rough)
    possible = minor.hint("merge").join(placed.hint("merge"), ["band", "size"]).where((F.col("label") != F.col("label2")) & enough(rough) & F.when(same_centre & F.col("bits").isNotNull() & F.col("bits2").isNotNull(), enough(in_centre + beside)).otherwise(True))
    rest = possible.select(F.least("c", "c2").alias("a"), F.greatest("c", "c2").alias("b")).distinct()
    more = written(verified(rest, sets, percent).where("linked").select("a", "b"), "links")
    label = written(components(links.unionByName(more), paths), "labels")
    _released(spark)

    # the least id of each class, then of each component
    classes = sketched.where("c is not null").groupBy("c").agg(F.min("id").alias("id")).join(label.withColumnRenamed("node", "c"), "c", "left").select("c", "id", F.coalesce("label", "c").alias("label"))
    classes = scratch.table(classes, "classes")
    for path in paths:
        common.drop_path(spark, path)
    # written, so that the join on a component with very many classes isn't tied to the aggregate's partitions and can be split
    least_id = scratch.table(classes.groupBy("label").agg(F.min("id").alias("component")), "least")
    return sketched.select("id", "k", "n", "c"), classes.hint("merge").join(least_id.hint("merge"), "label").select("c", "label", "component")
