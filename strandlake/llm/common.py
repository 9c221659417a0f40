"""What the operators share: column picking, tables in the shared folder, native span finding."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name, so that extra columns never clash (not even in case)."""
    at = {c: i for i, c in enumerate(df.columns)}
    return numbered(df).select(
        *[F.col(f"_{at[n]}").alias(n) for n in names]
    )


def numbered(df: DataFrame) -> DataFrame:
    """The columns named _0, _1, ... by their places: safe to refer to, whatever their names."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a local master (one machine, as in tests) gets a temporary folder; a cluster is refused, for
    there every executor would write to a disk of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="strandlake-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        at = f"file://{at}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/strandlake/{tag}-{uuid.uuid4().hex[:12]}"


def _file_system(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def materialise(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Cut lineage: write as Parquet in the shared folder, read back. Also returns the path.

    What nobody drops before goes when the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    files, p = _file_system(spark, path)
    files.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    files, p = _file_system(spark, path)
    files.delete(p, True)
    files.cancelDeleteOnExit(p)


class Scratch:
    """Tables in the shared folder that live as long as their block, or until the driver ends if there is none."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.names = spark, [], []

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        out, path = materialise(df, tag)
        self.paths.append(path)
        return out

    def bucketed(self, df: DataFrame, tag: str, n: int, column: str) -> DataFrame:
        """Laid out by the column, so that joins on it need no shuffle."""
        name, path = f"strandlake_{tag}_{uuid.uuid4().hex[:12]}", new_path(self.spark, tag)
        df.repartition(n, column).write.bucketBy(n, column).sortBy(column).option("path", path).saveAsTable(name)
        files, p = _file_system(self.spark, path)
        files.deleteOnExit(p)
        self.names.append(name)
        self.paths.append(path)
        return self.spark.table(name)

    def kept(self, df: DataFrame, tag: str) -> DataFrame:
        """A result that outlives the block."""
        return materialise(df, tag)[0]

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            drop_path(self.spark, path)
        self.names, self.paths = [], []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


#: Items in one block of a running total.
RUN = 256


def _blocks(items: Column) -> Column:
    """An array, not empty, as an array of arrays of RUN items."""
    starts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int"))
    return F.transform(starts, lambda b: F.slice(items, b * RUN + 1, F.lit(RUN)))


def running(sizes: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of sizes (int, not negative) the total by ``add`` of those before it, 0 at first.

    An array that grows by an item a step costs the square of its length, so totals are made of blocks first and
    within blocks then.
    """

    def before(first: Column, some: Column) -> Column:
        start = F.struct(first.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        step = lambda s, n: F.struct(add(s["at"], n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(some, start, step, lambda s: s["out"])

    def over(blocks: Column) -> Column:
        firsts = before(F.lit(0), F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), add)))
        return F.flatten(F.zip_with(firsts, blocks, before))

    return bound(sizes, lambda n: F.when(F.size(n) > 0, bound(_blocks(n), over)).otherwise(F.expr("cast(array() as array<int>)")))


def spans_of(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """All matches (that keep, if given, is true of), leftmost and non-overlapping, as array<struct<start,end,match>>; code points, end exclusive.

    split() and regexp_extract_all() walk the same matches, so the lengths of what lies between
    them and of the matches themselves add up to positions.
    """
    empty = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length)
        pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        return bound(pairs, lambda x: F.zip_with(x, running(F.transform(x, lambda p: p["gap"] + F.length(p["match"])), lambda a, n: a + n), span))

    def span(x: Column, before: Column) -> Column:
        start = before + x["gap"]
        return F.struct(start.alias("start"), (start + F.length(x["match"])).alias("end"), x["match"].alias("match"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = bound(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(empty))
    return F.filter(spans, lambda s: keep(s["match"])) if keep else spans


def joined(spans: Column) -> Column:
    """kind:start:end of an ordered array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def in_order(*kinds: tuple[str, Column]) -> Column:
    """One array<struct<start,rank,kind,end,match>>, by start and then by the order of the kinds given."""
    def tagged(i: int, kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["match"].alias("match"))

    parts = [F.transform(spans, tagged(i, kind)) for i, (kind, spans) in enumerate(kinds)]
    return F.sort_array(F.concat(*parts))


def redacted(text: Column, spans: Column, mark: str | Callable[[Column], Column]) -> Column:
    """The text with each maximal run of overlapping spans, given in order, replaced by the mark (of its first span)."""
    of = mark if callable(mark) else lambda x: F.lit(mark)

    def pieces(block: Column) -> Column:
        # a walk to a place in the text starts at the block's first place, not at the text's
        at = block[0]["before"]
        stretch = F.substring(text, at + 1, F.greatest(F.element_at(block, -1)["x"]["start"] - at, F.lit(0)))

        def piece(stretch: Column, p: Column) -> Column:
            before, start = p["before"], p["x"]["start"]
            # a span that starts inside what is already replaced only moves the end
            return F.when(start >= before, F.concat(F.substring(stretch, before - at + 1, start - before), of(p["x"]))).otherwise("")

        return bound(stretch, lambda t: F.array_join(F.transform(block, lambda p: piece(t, p)), ""))

    def whole(x: Column) -> Column:
        ends = F.transform(x, lambda s: s["end"])
        placed = F.zip_with(x, running(ends, lambda a, b: F.greatest(a, b)), lambda s, before: F.struct(s.alias("x"), before.alias("before")))
        parts = F.array_join(bound(placed, lambda p: F.transform(_blocks(p), pieces)), "")
        return F.concat(parts, F.substring(text, F.array_max(ends) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(bound(spans, whole))
