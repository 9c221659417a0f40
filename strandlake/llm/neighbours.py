"""Approximate nearest neighbours by cross-polytope hashing.

Equal vectors are one class from the start. Vectors are scaled by the largest norm and get one more component that makes them
unit vectors, which turns the largest inner product into the smallest angle. Each table rotates them pseudo-randomly
(three times random signs and a fast Hadamard transform) and files them under the nearest signed axis, or
under several such axes where there are many vectors. A query probes, in every table, the buckets whose axes
are nearest to it, as many as a calibration on a bounded sample of queries found necessary; members of
these buckets are ranked by their exact inner product. Every vector is in every table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TABLES = 8
#: Calibration: queries that are compared with all vectors, and the share of their neighbours to be found.
SAMPLE_QUERIES = 64
RECALL = 0.96
#: Vectors that one bucket should hold on average; more hash functions per table keep it so.
BUCKET = 1024
#: Members, and queries, of a bucket handled at once; larger buckets are split on both sides.
BLOCK = 2048
#: Probes that are made at once.
PROBE_ROWS = 1 << 18


class Hasher:
    def __init__(self, size: int, tables: int, functions: int, largest: float, seed: int = 7):
        self.size, self.tables, self.functions, self.largest = size, tables, functions, largest
        self.dim = 1 << max(2, int(size).bit_length())  # a power of two with an axis left for the added component
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, functions, 3, self.dim + 1))

    def unit(self, x: np.ndarray, member: bool) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1)
        out = np.zeros((len(x), self.dim))
        if member:
            out[:, : self.size] = x / self.largest
            out[:, self.size] = np.sqrt(np.maximum(0, 1 - (norm / self.largest) ** 2))
        else:
            out[:, : self.size] = x / norm[:, None]
        return out

    def axes(self, x: np.ndarray, table: int, function: int) -> np.ndarray:
        """The closeness of each vector to each of the 2 * dim signed axes."""
        for s in self.signs[table, function]:
            x = x * s[: self.dim]
            h = 1
            while h < self.dim:
                y = x.reshape(len(x), -1, 2, h)
                x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), self.dim)
                h *= 2
            x = x / math.sqrt(self.dim)
        return np.concatenate([x, -x], axis=1)

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for f in range(self.functions):
            out = out * (2 * self.dim) + self.axes(x, table, f).argmax(axis=1)
        return out

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The n buckets of the table nearest to each vector, nearest first."""
        best_key, best = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for f in range(self.functions):
            axes = self.axes(x, table, f)
            own = np.argsort(-axes, axis=1, kind="stable")[:, : min(n, 2 * self.dim)]
            key = best_key[:, :, None] * (2 * self.dim) + own[:, None, :]
            value = best[:, :, None] + np.take_along_axis(axes, own, 1)[:, None, :]
            key, value = key.reshape(len(x), -1), value.reshape(len(x), -1)
            order = np.argsort(-value, axis=1, kind="stable")[:, :n]
            best_key, best = np.take_along_axis(key, order, 1), np.take_along_axis(value, order, 1)
        return best_key


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of doubles, filled with zeros up to ``size`` components."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(lengths), size))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components: the same for the same two vectors anywhere."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _best(queries: np.ndarray, members: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, member row, score) of the k best members of each query; equal scores by id."""
    found = []
    for start in range(0, len(queries), 512):
        q = queries[start : start + 512]
        scores = q @ members.T
        if len(members) > k:
            # whatever could be among the k best but for the last bits of the product
            least = -np.partition(-scores, k - 1, axis=1)[:, k - 1] - 1e-9 * (1 + np.abs(scores).max(axis=1))
            r, m = np.nonzero(scores >= least[:, None])
        else:
            r, m = (i.ravel() for i in np.indices(scores.shape))
        exact = _exact(q[r], members[m])
        order = np.lexsort((ids[m], -exact, r))
        r, m, exact = r[order], m[order], exact[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        found.append((r[rank < k] + start, m[rank < k], exact[rank < k]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _probe_limit(hasher: Hasher, queries: np.ndarray, near: list[np.ndarray], recall: float) -> int:
    """The least number of probes per table that finds the wanted share of the sample's neighbours."""
    every = (2 * hasher.dim) ** hasher.functions
    n = min(every, 4096)
    if not near:
        return 1
    q = hasher.unit(queries, False)
    filed = [[hasher.buckets(hasher.unit(v, True), t) for t in range(hasher.tables)] for v in near]
    while True:
        ranks = []
        for i, buckets in enumerate(filed):
            best = np.full(len(buckets[0]), n)
            for t, b in enumerate(buckets):
                probes = hasher.probes(q[i : i + 1], t, n)[0]
                order = np.argsort(probes)
                at = order[np.minimum(np.searchsorted(probes, b, sorter=order), n - 1)]
                best = np.minimum(best, np.where(probes[at] == b, at, n))
            ranks.append(best)
        ranks = np.sort(np.concatenate(ranks))
        last = ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]
        if last < n or n == every:
            return int(min(n, last + 1))
        n = min(every, 4 * n)  # as far as all buckets, which is an exact scan


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, tables: int = TABLES, recall: float = RECALL, sample_queries: int = SAMPLE_QUERIES, bucket: int = BUCKET) -> DataFrame:
    """The k rows of largest inner product with each query row, nearest first, equal scores by smaller id.

    ``is_query`` is a condition on a column named id. Returns query_id, rank (from 1), the id and the score, in double precision on
    the given vectors; a query's own id is no candidate. Null or empty vectors, vectors of zeros and vectors
    that hold a null, NaN or infinity take no part, nor do null ids; shorter vectors are filled with zeros; rows repeated
    with the same id and vector count once; with fewer candidates all are returned; an empty table gives an empty result;
    other columns are not read.
    """
    with common.Scratch(vectors.sparkSession) as scratch:
        return _nearest(vectors, is_query, id_col, vector_col, k, tables, recall, sample_queries, bucket, scratch)


def _nearest(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, k: int, tables: int, recall: float, sample_queries: int, bucket: int, scratch: common.Scratch) -> DataFrame:
    spark = vectors.sparkSession
    base = common.pick(vectors, id_col, vector_col).toDF("id", "v").where(
        F.col("id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    # the ids of a class: the k + 1 smallest; a hot class is met in parts first
    few = lambda x: F.slice(F.sort_array(x), 1, k + 1)
    parts = base.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(4096)).alias("part")).agg(few(F.collect_set("id")).alias("ids"))
    classes = parts.groupBy("v").agg(few(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    classes = scratch.table(classes.select(F.element_at("ids", 1).alias("c"), "ids", "v"), "classes")
    n, size, largest = classes.agg(F.count("*"), F.max(F.size("v")), F.max(F.sqrt(squares))).first()
    id_type = base.schema["id"].dataType
    result = T.StructType([T.StructField("query_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField(id_col, id_type), T.StructField("score", T.DoubleType())])
    if not n:
        return spark.createDataFrame([], result)

    asked = base.where(is_query).distinct()
    queries = scratch.table(asked.join(classes.select("c", "v"), "v").select(F.col("id").alias("query_id"), "c"), "queries")
    wanted = scratch.table(classes.join(queries.select("c").distinct(), "c").select("c", "v"), "wanted")

    # calibration against all classes
    sample = wanted.orderBy(F.xxhash64("c"), "c").limit(sample_queries).collect()
    if not sample:
        return spark.createDataFrame([], result)
    functions = max(1, round(math.log(max(1, n / bucket)) / math.log(4 * size)))
    hasher = Hasher(size, tables, functions, largest)
    s_matrix = _matrix(pa.array([r.v for r in sample], pa.list_(pa.float64())), size)
    s_ids = np.array([r.c for r in sample])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            x, c = _matrix(b.column(1), size), b.column(0).to_numpy(zero_copy_only=False)
            if kept is not None:
                x, c = np.concatenate([x, kept[0]]), np.concatenate([c, kept[1]])
            i, m, score = _best(s_matrix, x, c, k + 1)
            keep = np.unique(m)
            kept = x[keep], c[keep]
        if kept is not None:
            i, m, score = _best(s_matrix, *kept, k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(kept[1][m]), pa.array(score), pa.array(list(kept[0][m]), pa.list_(pa.float64()))], names=["i", "c", "score", "v"])

    near = classes.select("c", "v").mapInArrow(scan, T.StructType([T.StructField("i", T.LongType()), T.StructField("c", id_type), T.StructField("score", T.DoubleType()), T.StructField("v", T.ArrayType(T.DoubleType()))]))
    order = W.partitionBy("i").orderBy(F.desc("score"), "c")
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("i", "c", "v").collect()
    lists: list[list] = [[] for _ in sample]
    for r in near:
        if r.c != s_ids[r.i]:
            lists[r.i].append(r.v)
    have = [i for i, x in enumerate(lists) if x]
    limit = _probe_limit(hasher, s_matrix[have], [np.array(lists[i][:k]) for i in have], recall)

    # members and probes of all tables
    # vectors travel as bytes of the given precision
    raw = np.dtype("<f4") if isinstance(classes.schema["v"].dataType.elementType, T.FloatType) else np.dtype("<f8")
    filed = T.StructType([T.StructField("table", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("c", id_type), T.StructField("v", T.BinaryType())])

    def file_under(probes: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                step = max(1, min(2048, PROBE_ROWS // (probes or 1)))
                for start in range(0, whole.num_rows, step):
                    b = whole.slice(start, step)
                    given = _matrix(b.column(1), size)
                    packed = pa.array([v.tobytes() for v in given.astype(raw)], pa.binary())
                    x = hasher.unit(given, probes is None)
                    for t in range(tables):
                        found = hasher.buckets(x, t)[:, None] if probes is None else hasher.probes(x, t, probes)
                        take = pa.array(np.repeat(np.arange(len(x)), found.shape[1]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(found.size, t, np.int32)), pa.array(found.ravel()), b.column(0).take(take), packed.take(take)], names=filed.names)

        return run

    members = classes.select("c", "v").mapInArrow(file_under(None), filed)
    probing = wanted.select("c", "v").mapInArrow(file_under(limit), filed)
    # a large bucket becomes a grid: its members are dealt to parts, its queries to rows, and every part meets every row once
    cut = lambda x, name: x.groupBy("table", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name)).where(F.col(name) > 1)
    parts, asked_parts = cut(members, "parts"), cut(probing, "rows")
    dealt = lambda n: F.when(F.col(n) > 1, F.pmod(F.xxhash64("c"), F.col(n))).otherwise(0).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    grid = lambda x: x.join(parts, ["table", "bucket"], "left").join(asked_parts, ["table", "bucket"], "left")
    members = grid(members).withColumn("part", dealt("parts")).withColumn("row", each("rows")).drop("parts", "rows")
    probing = grid(probing).withColumn("row", dealt("rows")).withColumn("part", each("parts")).drop("parts", "rows")

    pair = T.StructType([T.StructField("q", id_type), T.StructField("c", id_type), T.StructField("score", T.DoubleType())])

    def rerank(asking: pa.Table, filed_: pa.Table) -> pa.Table:
        q_ids, m_ids = (x.column("c").to_numpy() for x in (asking, filed_))
        if not len(q_ids) or not len(m_ids):
            return pa.table({"q": pa.array([], asking.schema.field("c").type), "c": pa.array([], asking.schema.field("c").type), "score": pa.array([], pa.float64())})
        unpacked = lambda x: np.frombuffer(b"".join(x.column("v").to_pylist()), raw).reshape(-1, size).astype(np.float64)
        i, m, score = _best(unpacked(asking), unpacked(filed_), m_ids, k + 1)
        return pa.table({"q": q_ids[i], "c": m_ids[m], "score": score})

    by = ["table", "bucket", "part", "row"]
    found = probing.groupBy(*by).cogroup(members.groupBy(*by)).applyInArrow(rerank, pair)
    found = found.groupBy("q", "c").agg(F.max("score").alias("score"))
    ranked = lambda df, key, *order_: df.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(*order_)))
    found = ranked(found, "q", F.desc("score"), F.col("c")).where(F.col("r") <= k + 1)
    listed = found.join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("id"))
    listed = scratch.table(ranked(listed, "q", F.desc("score"), F.col("id")).where(F.col("r") <= k + 1), "listed")
    out = queries.join(listed, queries["c"] == listed["q"]).where("id <> query_id").select("query_id", "id", "score", "r")
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("r"))).where(F.col("rank") <= k)
    return scratch.kept(out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"), "nearest")
