"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Every word is a bag of hashed character n-grams and of itself, so that unseen misspellings share
most vectors with what was seen. A passage's hidden vector is the mean of its words' vectors, a linear
softmax over two classes sits on top, and both are learned together by AdaGrad. A document is as toxic as its
most toxic passage of a few words, in training and in scoring, so a long clean text doesn't dilute an insult.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .anchors import mix
from .words import WordTable, rows, split, trim

BUCKETS = 1 << 16
DIM = 16
PASSAGE = 6
#: Subwords in fewer training documents than this keep a zero vector: one label alone can't be learned by heart. Samples with
#: few rows of label 1 ask for a quarter of their number, and for two at least.
MIN_DOCUMENTS = 8
#: How far a subword's vector leans at the start towards how much more often it stands in documents of label 1.
LEAN, PRIOR = 8.0, 0.5
DECAY = 1e-4
GRAMS = (3, 4, 5)
#: Bound of the training sample: labelled rows of either class. All labelled rows are used if there are fewer.
SAMPLE_ROWS = 6_000
#: Bound of the sample's text: one task learns from it. Rows that come after it is reached, in the order of a hash, are left out.
SAMPLE_BYTES = 256_000_000
EPOCHS = 10


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def grams(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of the words themselves and of their n-grams between marks, without case or punctuation at the ends."""
    texts = ["<" + w.decode("utf-8", "replace").lower().strip(".,;:!?\"'()[]") + ">" for w in words]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    word_of = np.repeat(np.arange(len(texts)), lengths)
    ends = np.cumsum(lengths)[word_of]
    owners, found = [np.arange(len(texts))], [np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64)]
    for n in GRAMS:
        at = np.flatnonzero(np.arange(n, len(codes) + n) <= ends)
        total = np.full(len(at), n, np.uint64)
        for i in range(n):
            total = total + codes[at + i] * _FACTORS[i]
        owners.append(word_of[at])
        found.append(mix(total))
    return np.concatenate(owners), (np.concatenate(found) % np.uint64(buckets)).astype(np.int64)


def subwords(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(flat bucket ids in the order of the words, number of them for each word)."""
    kind = np.uint16 if buckets <= 1 << 16 else np.int32
    flat, counts = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for start in range(0, len(words), 20_000):
        part = words[start : start + 20_000]
        owners, found = grams(part, buckets)
        flat.append(found[np.argsort(owners, kind="stable")].astype(kind))
        counts.append(np.bincount(owners, minlength=len(part)))
    return np.concatenate(flat), np.concatenate(counts)


class Model:
    """vectors (buckets x dim), weights (dim), bias: logit of a passage = mean over words of mean over subwords of vector . weights + bias."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: float):
        self.per_bucket, self.bias = (vectors @ weights).astype(np.float32), float(bias)

    def word_logits(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.float32)
        out = []
        for start in range(0, len(words), 20_000):
            part = words[start : start + 20_000]
            owners, found = grams(part, len(self.per_bucket))
            out.append(np.bincount(owners, self.per_bucket[found], len(part)) / np.bincount(owners, minlength=len(part)))
        return np.concatenate(out).astype(np.float32)


def passages(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the passages of a text of n words: half overlapping, the last one ends with the text."""
    if n <= size:
        return np.array([0]), np.array([n])
    starts = np.arange(0, n - size, size // 2)
    starts = np.append(starts, n - size)
    return starts, starts + size


def train(texts: list[str] | pa.Array, labels: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, size: int = PASSAGE, epochs: int = EPOCHS, rate: float = 0.5, min_documents: int = MIN_DOCUMENTS, decay: float = DECAY, warm_up: int = 2, positive_weight: float = 2.0, trust: float = 0.7, lean: float = LEAN, prior: float = PRIOR, seed: int = 17) -> Model:
    """Joint gradient descent; each document is stood for by its currently most toxic passage.

    The first passages are chosen, and the descent starts, by the log odds of subwords over documents: with few rows of label 1
    random passages hold too few of the words that matter. A model of constant probability if either class is missing.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float64)
    positive = labels.sum()
    if not 0 < positive < len(labels):
        p = (positive + 0.5) / (len(labels) + 1)
        return Model(np.zeros((buckets, dim)), np.zeros(dim), np.log(p / (1 - p)))
    at, distinct, ends = split(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    at = at.astype(np.int32)
    flat, counts = subwords(distinct, buckets)
    del distinct, texts
    offsets = np.concatenate([[0], np.cumsum(counts)])
    vectors = rng.normal(0, 0.1, (buckets, dim))
    weights, bias = rng.normal(0, 0.3, dim), float(np.log(positive / (len(labels) - positive)))
    g_vectors, g_weights, g_bias = np.full(buckets, 1e-6), np.full(dim, 1e-6), 1e-6
    starts = np.concatenate([[0], ends[:-1]])
    in_documents = np.zeros((2, buckets), np.int64)
    for a, b, y in zip(starts.tolist(), ends.tolist(), labels.astype(int).tolist(), strict=True):
        own = np.unique(at[a:b])
        lengths = counts[own]
        stop = np.cumsum(lengths)
        in_documents[y, np.unique(flat[np.repeat(offsets[own] - stop + lengths, lengths) + np.arange(stop[-1] if len(own) else 0)])] += 1
    known = in_documents.sum(axis=0) >= max(2, min(min_documents, int(positive) // 4))
    vectors[~known] = 0
    # the start: how much more often a subword stands in documents of label 1
    odds = np.log((in_documents[1] + prior) / (positive + 2 * prior)) - np.log((in_documents[0] + prior) / (len(labels) - positive + 2 * prior))
    odds[~known] = 0
    vectors += lean * odds[:, None] * weights / (weights @ weights)
    windows = [passages(int(e - s), size) for s, e in zip(starts, ends, strict=True)]
    for epoch in range(epochs):
        # the passage of each document that the present model finds most toxic
        per_word = _word_means((vectors @ weights).astype(np.float32), flat, offsets)
        sums = np.concatenate([[0.0], np.cumsum(per_word[at])])
        chosen = []
        for i, (a, b) in enumerate(windows):
            a, b = a + starts[i], b + starts[i]
            k = np.argmax((sums[b] - sums[a]) / np.maximum(1, b - a))
            chosen.append((a[k], b[k]))
        for part in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 64)):
            words = [at[chosen[i][0] : chosen[i][1]] for i in part]
            n_words = np.array([len(w) for w in words])
            w = np.concatenate(words)
            doc = np.repeat(np.arange(len(part)), n_words)
            n_grams = counts[w]
            own_ends = np.cumsum(n_grams)
            grams_ = flat[np.repeat(offsets[w] - own_ends + n_grams, n_grams) + np.arange(own_ends[-1] if len(w) else 0)]
            share = np.repeat(1.0 / (n_grams * n_words[doc]), n_grams)
            touched, inverse = np.unique(grams_, return_inverse=True)
            # the share of each touched bucket in each document's mean
            mixed = np.bincount(np.repeat(doc, n_grams) * len(touched) + inverse, share, len(part) * len(touched)).reshape(len(part), len(touched))
            hidden = mixed @ vectors[touched]
            likely = 1 / (1 + np.exp(-np.clip(hidden @ weights + bias, -30, 30)))
            error = likely - labels[part]
            error *= np.where(labels[part] == 1, positive_weight, 1.0)
            if epoch >= warm_up:  # the generalised cross entropy: labels that the rest contradicts pull less
                error *= np.where(labels[part] == 1, likely, 1 - likely) ** trust
            d_weights, d_bias = hidden.T @ error / len(part) + 1e-4 * weights, error.mean()
            amount = mixed.T @ error
            d_vectors = (amount[:, None] * weights + decay * vectors[touched]) * known[touched][:, None]
            g_vectors[touched] += (d_vectors**2).mean(axis=1)
            vectors[touched] -= rate * d_vectors / np.sqrt(g_vectors[touched])[:, None]
            g_weights += d_weights**2
            weights -= rate * 0.3 * d_weights / np.sqrt(g_weights)
            g_bias += d_bias**2
            bias -= rate * 0.3 * d_bias / np.sqrt(g_bias)
    return Model(vectors, weights, bias)


def _word_means(per_bucket: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mean over each word's subwords, some words at a time."""
    out = np.empty(len(offsets) - 1)
    for start in range(0, len(out), 20_000):
        stop = min(len(out), start + 20_000)
        own = offsets[start : stop + 1]
        out[start:stop] = np.add.reduceat(per_bucket[flat[own[0] : own[-1]]], own[:-1] - own[0]) / np.diff(own)
    return out


def best_passages(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The largest mean of any passage of ``size`` words in a row (all words of shorter texts); 0 without words."""
    out = np.zeros(len(starts))
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if b - a > size:
            out[i] = (sums[a + size : b + 1] - sums[a : b - size + 1]).max() / size
        elif b > a:
            out[i] = (sums[b] - sums[a]) / (b - a)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", trainable=None, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, **options) -> Model:
    """Learns from a sample of at most ``sample_rows`` labelled ids, taken by a hash of the id, and about ``sample_bytes`` of text.

    ``trainable`` is a condition on the id that rows for learning meet. Null labels and null ids are left out; an
    id that is labelled twice counts with its largest label; texts are learned from whole. Repeated rows of an id are
    learned from too, up to twice the sample's rows in all.
    """
    x = common.pick(docs, id_col, text_col).toDF("id", "text")
    y = common.pick(labels, id_col, label_col).toDF("id", "label").where("id is not null and label is not null")
    if trainable is not None:
        y = y.where(trainable(F.col("id")))
    y = y.groupBy("id").agg(F.max("label").alias("label"))
    # the same rows at every run: those of the smallest hashes
    y = y.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    sample = x.join(F.broadcast(y), "id").select("id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("double").alias("label"))
    sample = sample.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(2 * sample_rows).select("text", "label")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if size < sample_bytes and b.num_rows:
                held.append(b)
                size += b.nbytes
        if held:
            texts = pa.concat_arrays([b.column(0) for b in held])
            model = train(texts, np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in held]), **options)
            yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([model.per_bucket.tobytes()], pa.binary())], names=["bias", "logits"])
            del texts, held
            trim()

    # the bounded sample is one task's work on an executor; only a number for each bucket reaches the driver
    learned = sample.coalesce(1).mapInArrow(learn, "bias double, logits binary").collect()
    if not learned:
        return train([], np.zeros(0), **options)
    model = Model(np.zeros((1, 1)), np.zeros(1), learned[0].bias)
    model.per_bucket = np.frombuffer(learned[0].logits, np.float32)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", size: int = PASSAGE) -> DataFrame:
    """The id and the probability of label 1 of every whole text (a null text is empty).

    Empty texts get the model's bias. One row for each input row; other columns are not read; the
    learned numbers travel with the task: a fixed ``buckets`` floats.
    """
    docs = common.pick(docs, id_col, text_col)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.per_bucket, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, kind = _scorer(shared.value, size), None

        def typed():
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        for ids, texts in rows(typed()):
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(scorer(texts))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _scorer(learned: tuple, size: int):
    model = Model.__new__(Model)
    model.per_bucket, model.bias = learned
    table = WordTable(model.word_logits)

    def scores(texts: pa.Array) -> np.ndarray:
        at, distinct, ends = split(texts)
        sums = np.concatenate([[0.0], np.cumsum(table.of(distinct)[at].astype(np.float64))])
        logits = best_passages(sums, np.concatenate([[0], ends[:-1]]), ends, size) + model.bias
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))

    return scores


def filtered(docs: DataFrame, model: Model, reject: float, text_col: str = "text", size: int = PASSAGE) -> DataFrame:
    """The documents, with all their columns, whose score is below ``reject``.

    A null or empty text is judged by the model's bias; repeated rows are judged alike and stay rows of their own; further
    columns may have any names; an empty table gives an empty result.
    """
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.per_bucket, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value, size)
        for whole in batches:
            # the row numbers stand in for ids
            numbered = pa.RecordBatch.from_arrays([pa.array(range(whole.num_rows)), whole.column(at)], names=["i", "text"])
            for numbers, texts in rows(iter([numbered])):
                keep = pa.array(scorer(texts) < reject)
                yield whole.slice(numbers[0], len(numbers)).filter(keep)

    plain = common.numbered(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
