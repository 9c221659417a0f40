"""Connected components of an edge table of longs, without leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, paths: list | None = None) -> DataFrame:
    """(node, label) of every node with an edge; the label is the least node of its component.

    Alternating large and small stars: each round hangs a node's neighbours on the least of them;
    logarithmically many rounds. Every round is written to the shared folder, so lost executors cost a round
    at most; the last table's path is added to ``paths``. Hot nodes are met by partial aggregation (the minimum) and by joins that AQE can split.
    """
    spark = edges.sparkSession
    edges, path = common.materialise(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # now every edge points from the larger to the smaller node
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        fresh, fresh_path = common.materialise(small, "edges")
        state = tuple(fresh.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        common.drop_path(spark, path)
        edges, path = fresh, fresh_path
        if state == seen:
            break
        seen = state
    if paths is not None:
        paths.append(path)
    # at the fixed point every edge is (node, least of its component)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
