"""Repeats against a dictionary of all strings of the length."""

import hashlib
import random
from collections import Counter

import numpy as np

from strandlake.llm import repeats
from strandlake.llm.anchors import anchors
from strandlake.llm.queries import op4_repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        out.append((len(t), tuple(map(tuple, edges.reshape(-1, 2).tolist())), bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])))
    return out


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {d.doc_id: x for d, x in zip(docs, brute([d.text for d in docs], 400), strict=True)}
    got = {r.doc_id: r for r in op4_repeats(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(want)
    for d, (n, spans, kept) in want.items():
        r = got[d]
        assert r.repeated == (r.n_removed > 0) and (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
    assert any(spans for _, spans, _ in want.values())


def cases():
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefé ") for _ in range(n))
    shared = [noise(n) for n in (39, 40, 41, 70, 150, 900)]
    texts = [noise(rng.randrange(0, 200)) + rng.choice(shared) + noise(rng.randrange(0, 60)) for _ in range(60)]
    texts += [shared[3], shared[3], None, "", None, "x" * 500, "ab" * 300, noise(50) + "x" * 80, shared[5][100:400], shared[5][:39], "y" * 40, "z" * 41, texts[0], texts[0]]
    # copies with single edits
    for _ in range(40):
        t = list(shared[5])
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = "#"
        texts.append("".join(t))
    return texts


def test_against_brute_force(spark):
    texts = cases()
    rows = [(None if i == 7 else i, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long").repartition(3)
    want = sorted(((None if i == 7 else i), *x) for i, x in enumerate(brute(texts, 40)) if i != 7)
    for stretch in (1 << 20, 100):
        got = repeats.remove_repeats(df, length=40, stretch=stretch).collect()
        assert len(got) == len(texts)
        assert sorted((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in got if r.doc_id is not None) == want


def test_planted_passages(spark):
    """Passages of more than 50 words in otherwise unlike documents: those of 400 bytes go from each, shorter ones and clean documents stay."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(rng.randrange(4, 11)))
    words = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for p in range(40):
        passage = words(rng.choice([52, 60, 90, 300])) if p % 4 else " ".join(word()[:3] for _ in range(55))
        n = len(passage.encode())
        if 380 <= n < 400:
            continue  # whether the marks beside it make it long enough is not the question here
        for _ in range(rng.choice([2, 3, 20])):
            rows.append((len(rows), f"{words(rng.randrange(200))}\n# {passage} #\n{words(rng.randrange(200))}"))
            want[len(rows) - 1] = n if n >= 400 else 0
    for _ in range(100):
        rows.append((len(rows), words(rng.randrange(300))))
        want[len(rows) - 1] = 0
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for r in repeats.removed_digest(df).collect():
        # the marks and line ends beside a passage are shared too
        assert (want[r.doc_id] <= r.n_removed <= want[r.doc_id] + 12 if want[r.doc_id] else r.n_removed == 0) and r.repeated == (r.n_removed > 0) and r.n_bytes == len(rows[r.doc_id][1].encode())
    assert sum(n > 0 for n in want.values()) > 60


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_anchors():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 400).astype(np.uint64)
    want = {i for j in range(len(x) - 15) for i in range(j, j + 16) if x[i] == x[j : j + 16].min()}
    assert set(anchors(x, 16).tolist()) == want
