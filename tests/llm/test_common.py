"""Tables in the shared folder, spans and redaction."""

import os
import re

import pytest
from pyspark.sql import functions as F

from strandlake.llm import common, near_dups, neighbours, personal, repeats


def test_folder_must_be_shared_off_one_machine():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_tables_are_dropped(spark):
    folder = common.shared_dir(spark).removeprefix("file://") + "/strandlake"
    held = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    df = spark.createDataFrame([(i, f"word{i % 7} mail a{i}@b.org 10.0.0.{i % 9} " * 40) for i in range(40)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    tables = len(spark.catalog.listTables())
    for run, name in [
        (lambda: near_dups.near_duplicates(df), "components"), (lambda: near_dups.deduplicated(df), "kept"), (lambda: repeats.removed_digest(df), "digest"),
        (lambda: neighbours.nearest(vectors, F.col("id") % 20 == 0, recall=1.0), "nearest"),
    ]:
        before = held()
        assert run().count() > 0
        assert [x.rsplit("-", 1)[0] for x in held() - before] == [name] and len(spark.catalog.listTables()) == tables
    before = held()
    with common.Scratch(spark) as scratch:
        assert personal.scan_personal(df, scratch=scratch).count() == 40 and held() != before
    assert held() == before


def test_spans_and_redaction_of_many_matches(spark):
    texts = ["", "é", "ab1é22ß333", "7" * 10, " 5 x" * 2000 + "é", "ß" * 300 + "9 " * 700 + "ß9"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    spans = common.spans_of(F.col("t"), "[0-9]+")
    marked = common.in_order(("number", spans), ("wide", common.spans_of(F.col("t"), "[0-9] ?[a-zß]")))
    for r in df.select("i", "t", spans.alias("spans"), common.redacted(F.col("t"), marked, "#").alias("out")).collect():
        assert [(s.start, s.end, s.match) for s in r.spans] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", r.t)]
        both = sorted([(m.start(), 0, m.end()) for m in re.finditer("[0-9]+", r.t)] + [(m.start(), 1, m.end()) for m in re.finditer("[0-9] ?[a-zß]", r.t)])
        out, at = "", 0
        for start, _, end in both:
            if start >= at:
                out += r.t[at:start] + "#"
            at = max(at, end)
        assert r.out == out + r.t[at:]
