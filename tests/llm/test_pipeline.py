"""The pipeline stage by stage against plain versions, and as a whole."""

import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from strandlake.llm import toxicity
from tests.llm.test_near_dups import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == COLUMNS
    before, after = seen["toxicity"]
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), trainable=lambda x: F.crc32(x.cast("string").cast("binary")) % 3 != 1)
    scores = {r.doc_id: r.score for r in toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
    assert sorted(r.doc_id for r in after) == sorted(d for d, s in scores.items() if s < 0.7)
    before, after = seen["near_duplicates"]
    want = {d for d, n, c in brute([(r.doc_id, r.text) for r in before.values()]) if c == d}
    assert sorted(r.doc_id for r in after) == sorted(want) and all(r == before[r.doc_id] for r in after)
    before, after = seen["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = {d for d, r in before.items() if any(i in r.text for i in items)}
    assert leaky and {r.doc_id for r in after} == set(before) - leaky
    before, after = seen["secrets"]
    assert {r.doc_id for r in after} == set(before)
    for r in after:
        assert not re.search(r"[0-9a-f]{24}|AKIA[A-Z0-9]{16}", r.text)
        if "[SECRET]" in r.text:
            assert r.n_chars == len(r.text) and len(before[r.doc_id].text) != len(r.text) or "[SECRET]" in before[r.doc_id].text
        else:
            assert r == before[r.doc_id]
    before, after = seen["packing"]
    tokens, sequences = defaultdict(int), defaultdict(int)
    for r in after:
        tokens[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        assert tokens[r.doc_id] <= r.doc_tokens
    assert set(tokens) == set(before) and all(n <= 2048 and n & (n - 1) == 0 for n in sequences.values())
    whole = cp.run(spark, SF).collect()
    assert sum(r.length for r in whole) == sum(tokens.values()) and {r.doc_id for r in whole} == set(tokens)
    assert np.mean([n >= 256 for n in sequences.values()]) > 0.9


def test_nulls_and_empty_tables(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "x " * 20000, None, "b", 40000), (3, "token = abcdefgh", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for data in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            data = stage(spark, data, str(tmp_path))
            if name != "packing":
                data = spark.createDataFrame(data.collect(), data.schema)
        got = {r.doc_id for r in data.collect()}
        assert got in (set(), {None, 1, 2, 3})


def test_names_that_clash(spark, tmp_path):
    """Further columns named like those that stages need for themselves, or like the documents' in another case."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        rows = [(1, "a token=abcdefg b " * 3, "en", "s", 54, "A", 7, "k", 1.5, "sp"), (2, "one two three four five six", "en", "s", 27, "B", None, None, None, None), (3, "one two three four five six", None, None, None, "C", 8, "l", 2.5, "x")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Text string, DOC_ID int, __k string, score double, spans string")
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "Text", "DOC_ID", "__k", "score", "spans"]
    got = sorted(map(tuple, docs.collect()))
    assert got == [(1, "a [SECRET] b " * 3, "en", "s", 39, *rows[0][5:]), rows[1]]
    pieces = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {1, 2}
