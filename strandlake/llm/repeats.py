"""Exact repeats by distributed prefix doubling over content-chosen positions.

Every byte string of ``length`` bytes that also starts elsewhere is to be removed. Sorting all positions of a corpus
would shuffle many times its size, so positions are thinned first, without loss: an anchor is a position whose
following gram has the least fingerprint within a window. Any two equal strings of ``length`` bytes hold an anchor at the same
place, so a repeated string shows up as two anchors with equal ranks.

The string starts ``o`` bytes before its anchor, 0 <= o < width. (position, rank) pairs then grow by
rounds. A rank stands for the bytes that all strings of a range of offsets share (the core) and for the
bytes that any of them holds (the hull). Spark groups equal ranks:

* a core that is unique: no string of the range is repeated, the position leaves (unique);
* a hull that is not unique: all strings of the range are repeated, the position leaves (past the threshold); one
  position of each such class stays in, so that others can still meet it;
* else the range is cut into four, whose cores are longer and whose hulls are shorter, and ranked again.

Cores grow from a gram to the full length in log4(width) rounds. Ranks are fingerprints (two of 64 bits, core and hull), so
equal strings have equal ranks wherever they are, and no round needs the ranks of other positions.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .anchors import Fingerprints, anchors, mix

LENGTH = 400
#: Bytes fingerprinted at a time; longer texts are walked in overlapping stretches of this size.
STRETCH = 1 << 20


def _width(length: int) -> int:
    width = 4
    while width * 4 * 3 <= length * 2:
        width *= 4
    return width


def _stretches(texts: list[bytes], length: int, stretch: int) -> Iterator[list[tuple]]:
    """Lists of (document, its size, offset, bytes, first and end of the positions owned) of about ``stretch`` bytes."""
    margin, held, size = 2 * length, [], 0
    for d, text in enumerate(texts):
        n = len(text)
        if n < length:
            continue
        for first in range(0, n, stretch):
            end = min(n, first + stretch)
            low, high = max(0, first - margin), min(n, end + margin)
            if held and size + high - low > stretch + 2 * margin:
                yield held
                held, size = [], 0
            held.append((d, n, low, text[low:high], first, end))
            size += high - low
    if held:
        yield held


def _buffer(pieces: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p[3]) for p in pieces], np.int64)
    return np.frombuffer(b"".join(p[3] for p in pieces), np.uint8), np.cumsum(sizes) - sizes


def _ranks(prints: Fingerprints, at: np.ndarray, pos: np.ndarray, n: np.ndarray, x: np.ndarray, span: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(able, core, hull) of anchors at ``at`` in the buffer, at ``pos`` in texts of n bytes, for offsets x .. x + span - 1."""
    low, high = np.maximum(x, pos + length - n), np.minimum(x + span - 1, pos)
    able = low <= high
    at, x, low, high = at[able], x[able], low[able], high[able]
    salt = lambda *v: mix(sum((k.astype(np.uint64) << np.uint64(12 * i) for i, k in enumerate(v)), np.uint64(span)))
    core = prints.of(at - x, at - x - span + 1 + length) ^ salt(x)
    hull = prints.of(at - high, at - low + length, 1) ^ salt(x, low - x, high - x)
    return able, core.view(np.int64), hull.view(np.int64)


def _first_ranks(batches: Iterator[pa.RecordBatch], length: int, stretch: int) -> Iterator[pa.RecordBatch]:
    """(row, bytes) -> (row, place, core, hull) of all anchors; place = position * width + first offset."""
    width = _width(length)
    gram = length - width + 1
    for batch in batches:
        row_ids = batch.column(0).to_numpy(zero_copy_only=False)
        for start in range(0, batch.num_rows, 500):
            texts = batch.column(1).slice(start, 500).to_pylist()
            for pieces in _stretches(texts, length, stretch):
                buffer, starts = _buffer(pieces)
                prints = Fingerprints(buffer)
                grams = prints.of(np.arange(len(buffer) - gram + 1), np.arange(gram, len(buffer) + 1))
                at = anchors(grams, width)
                k = np.searchsorted(starts, at, "right") - 1
                facts = np.array([(d, n, low, first, end) for d, n, low, _, first, end in pieces], np.int64)
                pos = at - starts[k] + facts[k, 2]
                own = (pos >= facts[k, 3]) & (pos < facts[k, 4]) & (pos + gram <= facts[k, 1])
                at, k, pos = at[own], k[own], pos[own]
                able, core, hull = _ranks(prints, at, pos, facts[k, 1], np.zeros(len(at), np.int64), width, length)
                rows_ = row_ids[start + facts[k[able], 0]]
                yield pa.RecordBatch.from_arrays([pa.array(rows_), pa.array(pos[able] * width), pa.array(core), pa.array(hull)], names=["row", "place", "core", "hull"])


def _next_ranks(batches: Iterator[pa.RecordBatch], length: int, span: int, stretch: int) -> Iterator[pa.RecordBatch]:
    """(row, bytes, places) -> ranks of the four parts, ``span`` offsets each, of every place."""
    width = _width(length)
    for batch in batches:
        row_ids = batch.column(0).to_numpy(zero_copy_only=False)
        for start in range(0, batch.num_rows, 500):
            texts = batch.column(1).slice(start, 500).to_pylist()
            lists = batch.column(2).slice(start, 500)
            for pieces in _stretches(texts, length, stretch):
                buffer, starts = _buffer(pieces)
                prints = Fingerprints(buffer)
                made = []
                for k, (d, n, low, _, first, end) in enumerate(pieces):
                    places = lists[d].values.to_numpy(zero_copy_only=False)
                    pos = places // width
                    own = (pos >= first) & (pos < end)
                    places, pos = places[own], pos[own]
                    for part in range(4):
                        made.append((np.full(len(pos), row_ids[start + d]), pos - low + starts[k], pos, np.full(len(pos), n), places - pos * width + part * span))
                rows_, at, pos, n, x = (np.concatenate(c) for c in zip(*made, strict=True))
                able, core, hull = _ranks(prints, at, pos, n, x, span, length)
                yield pa.RecordBatch.from_arrays([pa.array(rows_[able]), pa.array((pos * width + x)[able]), pa.array(core), pa.array(hull)], names=["row", "place", "core", "hull"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(row, id, bytes, starts, ends) -> (id, n_bytes, spans, kept)."""
    width = _width(length)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for whole in batches:
        for first in range(0, whole.num_rows, 500):
            b = whole.slice(first, 500)
            out = []
            for text, found in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                spans: list = []
                for start, end in _intervals(found, len(text), width, length):
                    if spans and start <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], end)
                    else:
                        spans.append({"start": start, "end": end})
                at, kept = 0, []
                for s in spans:
                    kept.append(text[at : s["start"]])
                    at = s["end"]
                out.append((len(text), spans, b"".join([*kept, text[at:]])))
            n, spans, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.binary())], names=[b.schema.names[1], "n_bytes", "spans", "kept"])


def _intervals(found, n: int, width: int, length: int) -> list[tuple[int, int]]:
    """The bytes covered by each (place * 16 + round): strings of the round's offsets that lie within the text."""
    if not found.is_valid:
        return []
    codes = np.sort(found.values.to_numpy(zero_copy_only=False))
    places, span = codes // 16, width // 4 ** (codes % 16)
    pos, x = places // width, places % width
    low, high = np.maximum(x, pos + length - n), np.minimum(x + span - 1, pos)
    pairs = np.stack([pos - high, pos - low + length], axis=1)
    return [(int(a), int(b)) for a, b in pairs[np.argsort(pairs[:, 0], kind="stable")]]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, stretch: int = STRETCH) -> DataFrame:
    """Removes every byte of each whole text covered by a string of ``length`` bytes that starts anywhere else too.

    Returns a row for each input row: the id, n_bytes, spans (the maximal removed runs, array<struct<start,end>>, end
    exclusive) and kept (binary: the other bytes). Strings never cross rows and are judged on the input. A null
    text is empty; repeated rows are each other's repeats, so nothing of them is kept where they are long enough; null ids are
    rows of their own; texts shorter than ``length`` stay whole; an empty table gives an empty result; other
    columns are not read. The result reads a copy of the texts in the shared folder, which goes when the driver ends.
    """
    return _removed(docs, id_col, text_col, length, stretch, common.Scratch(docs.sparkSession))


def removed_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, stretch: int = STRETCH) -> DataFrame:
    """The id, n_bytes, n_removed, n_spans, kept_sha256 and repeated (1 if anything is removed, else 0) of ``remove_repeats``.

    All tables made on the way are dropped.
    """
    with common.Scratch(docs.sparkSession) as scratch:
        cut = _removed(docs, id_col, text_col, length, stretch, scratch)
        removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
        return scratch.kept(cut.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (removed > 0).cast("int").alias("repeated")), "digest")


def _removed(docs: DataFrame, id_col: str, text_col: str, length: int, stretch: int, scratch: common.Scratch) -> DataFrame:
    spark = docs.sparkSession
    width = _width(length)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranks = "row long, place long, core long, hull long"

    # one copy of the texts, laid out by row, so that no later round shuffles them
    docs = common.pick(docs, id_col, text_col).toDF("id", "text")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    texts = scratch.bucketed(texts, "texts", n, "row")
    _released(spark)

    positions, path = common.materialise(texts.select("row", "text").where(F.length("text") >= length).mapInArrow(lambda it: _first_ranks(it, length, stretch), ranks), "ranks")
    covers, span, level = [], width, 0
    while True:
        # positions whose core is not unique; written first, so that both sides of the join are dealt by it and a hot core can be split
        shared, shared_path = common.materialise(positions.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "shared")
        alive, alive_path = common.materialise(positions.hint("merge").join(shared.hint("merge"), "core").select("row", "place", "core", "hull"), "alive")
        common.drop_path(spark, path)
        common.drop_path(spark, shared_path)
        # classes of equal hulls; one position of each stands for it from now on
        classes, classes_path = common.materialise(alive.groupBy("core", "hull").agg(F.count("*").alias("n"), F.first("row").alias("row"), F.first("place").alias("place")), "classes")
        past = classes.where("n > 1").select("core", "hull")
        found = scratch.table(alive.hint("merge").join(past.hint("merge"), ["core", "hull"]).select("row", (F.col("place") * 16 + level).alias("code")), "covers")
        covers.append(found)
        common.drop_path(spark, alive_path)
        _released(spark)
        if span == 1:
            common.drop_path(spark, classes_path)
            break
        # ranges whose core is held by different hulls go on, in four parts
        mixed, mixed_path = common.materialise(classes.groupBy("core").agg(F.count("*").alias("hulls")).where("hulls > 1").select("core"), "mixed")
        waiting = classes.select("core", "row", "place").hint("merge").join(mixed.hint("merge"), "core").groupBy("row").agg(F.collect_list("place").alias("places"))
        span, level = span // 4, level + 1
        asked = texts.select("row", "text").join(waiting.hint("merge"), "row").select("row", "text", "places")
        positions, path = common.materialise(asked.mapInArrow(lambda it, s=span: _next_ranks(it, length, s, stretch), ranks), "ranks")
        common.drop_path(spark, classes_path)
        common.drop_path(spark, mixed_path)
        _released(spark)

    found = covers[0]
    for more in covers[1:]:
        found = found.unionByName(more)
    found = found.groupBy("row").agg(F.collect_list("code").alias("codes"))
    schema = T.StructType([
        T.StructField(id_col, docs.schema["id"].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType()),
    ])
    return texts.join(found.hint("merge"), "row", "left").select("row", F.col("id").alias(id_col), "text", "codes").mapInArrow(lambda it: _cut(it, length), schema)


def _released(spark) -> None:
    """Lets Spark drop shuffle files of finished rounds now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
