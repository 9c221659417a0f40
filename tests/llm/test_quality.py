"""Quality: held-out accuracy, the feature definitions, lookup tables against a plain sum, edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from strandlake.llm import quality
from strandlake.llm.queries import op7_quality


def test_held_out(spark):
    rows = {r.doc_id: r for r in op7_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows.values())
    held = [(rows[d].predicted, y) for d, y in labels.items() if rows[d].held_out]
    assert len(held) > 30 and np.mean([p == y for p, y in held]) > 0.95


def test_interaction_is_learned():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 3))
    y = (x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)
    model = quality.train(x[:3000], y[:3000], rounds=30)
    assert ((model.logits(x[3000:]) > 0) == y[3000:]).mean() > 0.95
    row = x[:1]
    b = model.bins(row)[0]
    total = model.bias + sum(t[b[f]] for f, t in enumerate(model.tables)) + sum(t[b[i], b[j]] for (i, j), t in model.pairs.items())
    assert abs(total - model.logits(row)[0]) < 1e-12


def test_features():
    got = dict(zip(quality.FEATURES, quality.features(pa.array(["One two, two.\nOne two, two.\n", ""]))[0], strict=True))
    assert got["distinct_share"] == 0.5 and got["repeated_lines"] == 0.5 and np.isclose(got["log_words"], np.log(7))
    assert got["title_words"] == 2 / 6 and got["commonest_word"] == 2 / 6 and got["commas"] == 2 / 6
    assert (quality.features(pa.array(["", " \n"])) == 0).all() and quality.features(pa.array([], pa.string())).shape == (0, len(quality.FEATURES))


def loop_features(text):
    """Text by text, word by word."""
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    if not words:
        return [0.0] * len(quality.FEATURES)
    n, size = len(words), len(raw)
    cores = [w.rstrip(b".,;:!?)\"'").decode("utf-8", "replace") for w in words]
    times = Counter(words)
    share = [c / n for c in times.values()]
    of = lambda marks: sum(b in marks for b in raw)
    lower, upper, digit = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
    symbol = bytes(b for b in range(33, 127) if b not in lower + upper + digit)
    beyond = sum(b > 127 for b in raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    mean = lambda x: sum(x) / n
    return [
        math.log1p(n), mean(len(c) for c in cores), len(times) / n, (of(lower) + of(upper)) / size, of(digit) / size, of(upper) / size, of(symbol) / size, beyond / size,
        (size - of(lower) - of(upper) - of(digit) - of(symbol) - beyond) / size, n / (raw.count(b"\n") + 1), 1 - len(set(lines)) / len(lines), n / (of(b".!?") + 1), raw.count(b",") / n,
        mean(not c.isalnum() for c in cores), mean(any(b in digit for b in w) for w in words), mean(c[:1].isupper() for c in cores), mean(len(c) <= 3 for c in cores), mean(len(c) >= 10 for c in cores),
        max(share), -sum(s * math.log(s) for s in share) / max(math.log(n), 1),
    ]


def test_scores_by_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000")
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: None, -2: "", -3: " \n", -4: "Ünï, çödé (x1)!"}
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    assert model.pairs and len(texts) > 100
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in quality.score(df, model).collect():
        x = loop_features(texts[r.doc_id])
        bins = [sum(e <= v for e in edges) for edges, v in zip(model.edges, x)]
        logit = model.bias + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[bins[i]][bins[j]] for (i, j), t in model.pairs.items())
        assert np.allclose(x, quality.features(pa.array([texts[r.doc_id] or ""]))[0], atol=1e-9)
        assert abs(r.score - 1 / (1 + math.exp(-logit))) < 1e-9 or min(abs(e - v) for edges, v in zip(model.edges, x) for e in edges) < 1e-12


def test_edge_cases(spark):
    rows = [(1, None, 1.0), (None, "", 1.0), (2, "word " * 50000, 1.0), (2, "word " * 50000, 1.0), (3, "plain text here", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, features double")
    for labels in ([], [(3, None)], [(3, 1), (2, 0), (2, 1), (None, 1)]):
        model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = quality.score(df, model).collect()
        assert sorted(str(r.doc_id) for r in got) == ["1", "2", "2", "3", "None"] and all(0 < r.score < 1 for r in got)
    assert quality.score(df.limit(0), model).collect() == []
