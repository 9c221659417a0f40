"""Quality: a generalised additive model with pairwise interactions.

Numbers that describe a whole text are put into bins. Boosting goes round the features: a shallow tree
over one feature's bins, grown on the present gradients, adds to that feature's lookup table. Then the
pairs of features that explain most of what is left get tables of two dimensions in the same way.
A score is the sum of the looked-up numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .words import as_bytes, rows, split

FEATURES = [
    "log_words", "word_length", "distinct_share", "letters", "digits", "upper", "symbols", "other_bytes", "spaces", "line_words",
    "repeated_lines", "sentence_words", "commas", "symbol_words", "digit_words", "title_words", "short_words", "long_words", "commonest_word", "word_entropy",
]
BINS = 24
ROUNDS = 150
PAIR_ROUNDS = 40
PAIRS = 6
#: Bound of the training sample: labelled rows, those of the smallest hashes of the id.
SAMPLE_ROWS = 20_000

_CLASS = np.zeros(256, np.int64)  # 0 space, 1 lower, 2 upper, 3 digit, 4 symbol, 5 beyond ASCII
_CLASS[33:127], _CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 4, 1, 2, 3, 5


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each whole text; zeros for texts without words."""
    n = len(texts)
    at, distinct, ends = split(texts)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    words = np.maximum(ends - starts, 1).astype(np.float64)
    doc = np.repeat(np.arange(n), ends - starts)
    raw = as_bytes(texts)
    sizes = np.array([len(t) for t in raw], np.int64)
    buffer = np.frombuffer(b"".join(raw), np.uint8)
    byte_doc = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(byte_doc * 6 + _CLASS[buffer], minlength=n * 6).reshape(n, 6)
    total = np.maximum(sizes, 1)
    per_doc = lambda marks: np.bincount(byte_doc[marks], minlength=n)
    lines = per_doc(buffer == 10) + 1
    sentences = per_doc((buffer == 46) | (buffer == 33) | (buffer == 63)) + 1
    commas = per_doc(buffer == 44)
    repeated = np.array([1 - len(set(x)) / len(x) if len(x := [y for y in t.split(b"\n") if y.strip()]) else 0.0 for t in raw])

    def facts(w: bytes) -> tuple:
        core = w.rstrip(b".,;:!?)\"'")
        text = core.decode("utf-8", "replace")
        return len(text), not text.isalnum(), any(c in b"0123456789" for c in w), text[:1].isupper()

    known = np.array([facts(w) for w in distinct], np.float64).reshape(len(distinct), 4)[at]
    by_word = lambda x: np.bincount(doc, x, n) / words
    # how often each word occurs in each text
    pairs, times = np.unique(doc * max(1, len(distinct)) + at, return_counts=True)
    pair_doc = pairs // max(1, len(distinct))
    share = times / words[pair_doc]
    top = np.zeros(n)
    np.maximum.at(top, pair_doc, share)
    out = np.stack([
        np.log1p(ends - starts), by_word(known[:, 0]), np.bincount(pair_doc, minlength=n) / words, (kinds[:, 1] + kinds[:, 2]) / total, kinds[:, 3] / total,
        kinds[:, 2] / total, kinds[:, 4] / total, kinds[:, 5] / total, kinds[:, 0] / total, words / lines,
        repeated, words / sentences, commas / words, by_word(known[:, 1]), by_word(known[:, 2]), by_word(known[:, 3]), by_word(known[:, 0] <= 3), by_word(known[:, 0] >= 10),
        top, -np.bincount(pair_doc, share * np.log(share), n) / np.maximum(np.log(words), 1),
    ], axis=1)
    out[ends == starts] = 0
    return out


class Gam:
    """edges per feature, a table per feature, {(i, j): table}, bias."""

    def __init__(self, edges: list[np.ndarray], tables: list[np.ndarray], pairs: dict, bias: float):
        self.edges, self.tables, self.pairs, self.bias = edges, tables, pairs, bias

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.bias)
        for f, table in enumerate(self.tables):
            out += table[b[:, f]]
        for (i, j), table in self.pairs.items():
            out += table[b[:, i], b[:, j]]
        return out


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Steps of a tree over ordered bins from the bins' sums of gradients and of curvatures."""
    out = np.full(len(g), -g.sum() / (h.sum() + ridge))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(left_g, left_h, ridge) + _gain(g.sum() - left_g, h.sum() - left_h, ridge)
        gains[(left_h < 1e-3) | (h.sum() - left_h < 1e-3)] = -1
        k = int(np.argmax(gains)) + 1
        if gains[k - 1] > _gain(g.sum(), h.sum(), ridge) + 1e-9:
            out = np.concatenate([_tree(g[:k], h[:k], depth - 1, ridge), _tree(g[k:], h[k:], depth - 1, ridge)])
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Steps of the best cut into four quadrants, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    parts = [(q(cg), q(ch)) for q in (
        lambda c: c[:-1, :-1], lambda c: c[:-1, -1:] - c[:-1, :-1], lambda c: c[-1:, :-1] - c[:-1, :-1], lambda c: c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])]
    gains = sum(_gain(a, b, ridge) for a, b in parts)
    i, j = np.unravel_index(np.argmax(gains), gains.shape)
    steps = [-a[i, j] / (b[i, j] + ridge) for a, b in parts]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = steps
    return out, float(gains[i, j] - _gain(tg, th, ridge))


def train(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, n_pairs: int = PAIRS, rate: float = 0.1, depth: int = 2, ridge: float = 5.0) -> Gam:
    """Cyclic boosting on the logistic loss; a constant if either class is missing."""
    y = np.asarray(y, np.float64)
    p = (y.sum() + 0.5) / (len(y) + 1)
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.zeros(0) for f in range(n_features)]
    model = Gam(edges, [np.zeros(len(e) + 1) for e in edges], {}, float(np.log(p / (1 - p))))
    if not 0 < y.sum() < len(y):
        return model
    b = model.bins(x)
    logit = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-logit))
        return q - y, q * (1 - q)

    for _ in range(rounds):
        for f in range(n_features):
            g, h = slopes()
            size = len(model.tables[f])
            step = rate * _tree(np.bincount(b[:, f], g, size), np.bincount(b[:, f], h, size), depth, ridge)
            model.tables[f] += step
            logit += step[b[:, f]]

    def histograms(i: int, j: int, *values: np.ndarray) -> list[np.ndarray]:
        shape = len(model.tables[i]), len(model.tables[j])
        code = b[:, i] * shape[1] + b[:, j]
        return [np.bincount(code, v, shape[0] * shape[1]).reshape(shape) for v in values]

    able = [(i, j) for i in range(n_features) for j in range(i + 1, n_features) if min(len(model.tables[i]), len(model.tables[j])) > 1]
    g, h = slopes()
    gains = {ij: _pair_tree(*histograms(*ij, g, h), ridge)[1] for ij in able}
    chosen = sorted(able, key=lambda ij: (-gains[ij], ij))[:n_pairs]
    model.pairs = {(i, j): np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            g, h = slopes()
            step = rate * _pair_tree(*histograms(i, j, g, h), ridge)[0]
            model.pairs[i, j] += step
            logit += step[b[:, i], b[:, j]]
    return model


def _typed(batches: Iterator[pa.RecordBatch], seen: list) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen[:] = [b.schema.field(0).type]
        yield b


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the FEATURES of every whole text, as an array of doubles; a null text is empty."""
    docs = common.pick(docs, id_col, text_col)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list = []
        for ids, texts in rows(_typed(batches, seen)):
            yield pa.RecordBatch.from_arrays([pa.array(ids, seen[0]), pa.array(list(features(texts)), pa.list_(pa.float64()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", trainable=None, sample_rows: int = SAMPLE_ROWS, **options) -> Gam:
    """Learns from at most ``sample_rows`` labelled rows, taken by a hash of the id; ``trainable`` is a condition on the id.

    Null labels and ids are left out; an id labelled twice counts with its largest label; repeated rows beyond
    twice the sample are left out. Only the features reach the driver.
    """
    y = common.pick(labels, id_col, label_col).toDF("id", "label").where("id is not null and label is not null")
    if trainable is not None:
        y = y.where(trainable(F.col("id")))
    y = y.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    x = common.pick(docs, id_col, text_col).toDF("id", "text")
    sample = x.join(F.broadcast(y), "id", "left_semi")  # at most sample_rows ids
    got = describe(sample, "id", "text").join(F.broadcast(y), "id").orderBy("id", "features").limit(2 * sample_rows).select("features", "label").toPandas()
    x = np.array(got["features"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    return train(x, got["label"].to_numpy(np.float64), **options)


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the probability of label 1 of every whole text (a null text is empty).

    One row for each input row, repeated rows and null ids too; other columns are not read. Texts
    without words get the score of their own bins. The model is a few tables of fixed size.
    """
    docs = common.pick(docs, id_col, text_col)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list = []
        for ids, texts in rows(_typed(batches, seen)):
            logits = shared.value.logits(features(texts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, seen[0]), pa.array(1 / (1 + np.exp(-logits)))], names=schema.names)

    return docs.mapInArrow(run, schema)
