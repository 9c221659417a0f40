"""Decontamination against plain dynamic programming, with planted edits."""

import random

from strandlake.llm import decontamination as dc
from strandlake.llm.queries import op8_decontamination


def semi_global(pattern, text):
    """Least distance of the pattern to any substring, and the first end of it."""
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(text, 1):
        diagonal, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            diagonal, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, diagonal + (p != c))
        best = min(best, (row[-1], j))
    return best


def edit(rng, text, n):
    chars = list(text)
    for _ in range(n):
        i = rng.randrange(len(chars))
        chars[i : i + 1] = rng.choice([[], [rng.choice("abc ")], [chars[i], rng.choice("xyz")]])
    return "".join(chars)


def test_myers():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        want = semi_global(p, t)
        got = dc.myers(p, t, len(p) - 1)
        if want[0] < len(p):
            assert got == want


def test_planted_edits_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 40)))) for i in range(12)]
    docs = []
    for d in range(60):
        text = " ".join(word() for _ in range(rng.randrange(0, 60)))
        if d % 2:
            text += " " + edit(rng, rng.choice(items)[1].upper(), rng.randrange(0, 14)) + "\n " + " ".join(word() for _ in range(20))
        docs.append((d, text, "x", 1))
    docs += [(None, items[0][1], "", 1), (100, None, "", 1), (101, "", "", 1), (102, items[1][1] * 300, "", 1), (0, docs[0][1], "x", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string, distance int")
    bench = spark.createDataFrame([*items, (50, None), (51, "short"), (0, items[0][1])], "item_id long, text string")
    want = []
    for d, t, *_ in docs:
        for i, p in items:
            p, t2 = dc.normal(p), dc.normal(t)
            if d == 102 and i != 1:
                continue
            distance, end = semi_global(p, t2[:2000])
            if len(p) >= dc.MIN_CHARS and distance <= int(len(p) * dc.RATE):
                want.append((d, i, distance, end))
    for block in (4_000_000, 400):
        found = dc.find_leaks(df, bench, block_bytes=block).collect()
        got = [(r.doc_id, r.item_id, r.distance, r.end) for r in found if r.doc_id != 102 or r.item_id == 1]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert len(want) > 15 and all(0 <= r.start < r.end for r in found)
    clean = dc.decontaminated(df, bench).collect()
    leaky = {r.doc_id for r in found}
    assert sorted((r.doc_id for r in clean), key=str) == sorted((d for d, *_ in docs if d not in leaky), key=str)
    assert clean[0].asDict().keys() == {"doc_id", "text", "item_id", "distance"}
    assert dc.find_leaks(df.limit(0), bench).collect() == [] and dc.find_leaks(df, bench.limit(0)).collect() == []


def test_short_items(spark):
    items = [(1, "What  is DNA?"), (2, "cat"), (3, " \n"), (4, "首都是哪里"), (5, None), (6, "é")]
    texts = ["so: what is\ndna? ok", "concatenate cats", "a CAT.", "中国的首都是哪里呢", "caf\u0065\u0301", "what is dnа?", "concat cat", "", None, "x e\u0301", "what is dna!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(0, 1, 0, 4, 16), (2, 2, 0, 2, 5), (3, 4, 0, 3, 8), (6, 2, 0, 7, 10), (9, 6, 0, 2, 3)]
    for block in (4_000_000, 8):
        assert sorted(map(tuple, dc.find_leaks(df, bench, block_bytes=block).collect())) == want
        kept = dc.decontaminated(df, bench, block_bytes=block).collect()
        assert sorted(r.doc_id for r in kept) == [1, 4, 5, 7, 8, 10]


def test_documents(spark):
    found = {(r.doc_id, r.item_id) for r in op8_decontamination(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    exact = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in (d.text or "")}
    assert exact and exact <= found and len(found) < 3 * len(exact)
