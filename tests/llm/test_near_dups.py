"""Near-duplicates against brute force over all pairs."""

import random
import re
from collections import defaultdict

import numpy as np

from strandlake.llm import near_dups, sketches
from strandlake.llm.graph import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    rows = near_dups.near_duplicates(df).collect()
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(1000 + i, edited(rng, base, rng.randrange(12))) for i in range(250)]
    rows += [(2000 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(40)) + " " + " ".join(base[:60])) for i in range(30)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, c int, band string")
    assert got(df) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (5, "ONE  two"), (None, "one two"), (None, "alone here"), (6, "one two three"),
            (7, "Ünï x y z w " * 4000), (8, "Ünï x y z w " * 4000), (9, "ÜNÏ x y z w " * 40), (10, "a b c d e"), (11, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []
    kept = near_dups.deduplicated(df).collect()
    assert sorted(str(r.doc_id) for r in kept if r.text and r.text.strip()) == ["10", "11", "4", "6", "7", "9", "None"]
    assert sorted(r.doc_id for r in kept if not (r.text or "").strip()) == [1, 2, 3]


def test_names_that_clash(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        rows = [(3, "a b c d e f", "x", "k", 1), (1, "a b c d e f", "y", "l", 2), (1, "a b c d e f", "y", "l", 2), (2, None, "z", None, 3), (None, "", None, None, None)]
        df = spark.createDataFrame(rows, "doc_id long, text string, DOC_ID string, __k string, c int")
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    got = near_dups.deduplicated(df)
    assert got.columns == df.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[1], rows[3], rows[4]]))


def test_many_components_in_one_band(spark):
    """Texts that share half of their shingles, so bands too, but are linked in pairs only."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([20, 45, 90]))]
        rows += [(3 * i, " ".join(base + own)), (3 * i + 1, " ".join(base + own + ["z"] * (i % 2)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_sketch_is_full_and_unbiased():
    rng = np.random.default_rng(3)
    for n in (1, 2, 10, 400, 5000):
        a = rng.integers(1, 2**63, n).astype(np.uint64)
        assert (sketches.sketch(a, 360) != np.iinfo(np.uint64).max).all()
        assert (sketches.sketch(a, 360) == sketches.sketch(a[::-1].copy(), 360)).all()
    errors = []
    for _ in range(40):
        x = rng.integers(1, 2**63, 300).astype(np.uint64)
        errors.append((sketches.sketch(x[:200], 360) == sketches.sketch(x[100:], 360)).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.015


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200, 202: 200}
