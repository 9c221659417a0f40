"""Toxicity: held-out quality, misspellings, long texts, edge cases."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from strandlake.llm import toxicity
from strandlake.llm.queries import op3_toxicity


def test_held_out(spark):
    rows = {r.doc_id: r for r in op3_toxicity(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert set(rows) == {r.doc_id for r in docs}
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    clean = [rows[d].predicted for d, y in labels.items() if y == 0 and rows[d].held_out]
    assert np.mean(clean) < 0.05
    # a fifth of the labels is noise: rows of label 1 without any of the words that all others share
    toxic = [d for d, y in labels.items() if y == 1]
    texts = {r.doc_id: r.text for r in docs}
    words = {d: set(re.findall("[a-z]+", texts[d].lower())) for d in labels}
    of = lambda w, y: sum(w in words[d] for d in labels if labels[d] == y)
    telling = {w for w in set().union(*[words[d] for d in toxic]) if of(w, 1) >= len(toxic) / 6 and of(w, 0) == 0}
    held = [rows[d].predicted for d in toxic if rows[d].held_out and words[d] & telling]
    assert len(telling) >= 8 and len(held) >= 10 and np.mean(held) >= 0.9


def loop_score(model, text, size=toxicity.PASSAGE):
    """Word by word, gram by gram."""
    full = 2**64
    factors = [int(f) for f in toxicity._FACTORS]

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % full
        return x ^ (x >> 31)

    logits = []
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        marked = "<" + word.lower().strip(".,;:!?\"'()[]") + ">"
        hashes = [xxhash.xxh3_64_intdigest(marked)]
        for n in toxicity.GRAMS:
            for i in range(len(marked) - n + 1):
                hashes.append(mixed((n + sum(ord(c) * f for c, f in zip(marked[i : i + n], factors))) % full))
        logits.append(sum(float(model.per_bucket[h % len(model.per_bucket)]) for h in hashes) / len(hashes))
    passages = [logits[i : i + size] for i in range(len(logits) - size + 1)] or ([logits] if logits else [])
    best = max((sum(x) / len(x) for x in passages), default=0.0)
    return 1 / (1 + math.exp(-(best + model.bias)))


def test_scores_by_loop(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 4000")
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: None, -2: "", -3: "you wretchling", -4: "ŒUF! \u00a0 (WRETCHLING)\x1f."}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in toxicity.score(df, model[0]).collect():
        assert abs(r.score - loop_score(model[0], texts[r.doc_id])) < 1e-4


def test_filtered(spark, model):
    rows = [(1, None, 0.5), (1, None, 0.5), (None, "", 0.1), (2, "wretchling " * 50, 0.2), (3, model[1][0], 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, TEXTS double")
    kept = toxicity.filtered(df, model[0], 0.7).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in df.collect() if r.doc_id != 2) and toxicity.filtered(df.limit(0), model[0], 0.7).collect() == []


def test_sample_bound(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 200) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert 0 < toxicity.fit(docs, labels, sample_bytes=1).bias + 100 < 200


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 9))) for _ in range(400)]
    texts, labels = [], []
    for i in range(900):
        words = list(rng.choice(vocabulary, rng.integers(10, 200)))
        if i % 5 == 0:
            for _ in range(3):
                words.insert(rng.integers(len(words)), rng.choice(["wretchling", "foulbrain", "snotgoblin"]))
        texts.append(" ".join(words))
        labels.append(i % 5 == 0)
    return toxicity.train(texts, np.array(labels)), vocabulary


def scores(model, texts):
    at, distinct, ends = toxicity.split(pa.array(texts))
    sums = np.concatenate([[0], np.cumsum(model.word_logits(distinct)[at])])
    return toxicity.best_passages(sums, np.concatenate([[0], ends[:-1]]), ends, toxicity.PASSAGE) + model.bias


def test_misspellings_and_long_texts(model):
    model, vocabulary = model
    clean = " ".join(np.random.default_rng(5).choice(vocabulary, 5000))
    low, exact, spelled, short = scores(model, [clean, clean + " wretchling " + clean, clean + " wretchlinng foulbrainn", "you wretchling"])
    assert low < 0 < exact and 0 < spelled and short > 0


def test_scoring_edge_cases(spark, model):
    rows = [(1, None, 0.5), (1, None, 0.5), (None, "", 0.1), (2, "wretchling " * 30000, 0.2), (3, " \n", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = toxicity.score(df, model[0]).collect()
    empty = 1 / (1 + np.exp(-model[0].bias))
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "None"]
    assert all(abs(r.score - empty) < 1e-9 for r in got if r.doc_id != 2) and max(r.score for r in got) > 0.9
    assert toxicity.score(df.limit(0), model[0]).collect() == []


def test_labels_missing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, None)], [(1, 1), (1, 1), (None, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert all(0 < r.score < 1 for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect())
