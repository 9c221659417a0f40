"""Nearest neighbours: recall and exact scores against brute force, ties, bad vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import neighbours
from strandlake.llm.queries import op5_neighbours


def brute(ids, x, query_ids, k=20):
    out = {}
    for q in query_ids:
        scores = x @ x[ids.index(q)]
        order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-round(scores[j], 12), ids[j]))[:k]
        out[q] = [(ids[j], scores[j]) for j in order]
    return out


def test_recall_on_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in op5_neighbours(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append(r)
    want = brute(ids, x, [i for i in ids if i % 20 == 0])
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21)) and len({r.vec_id for r in rows}) == 20 and q not in {r.vec_id for r in rows}
        for a, b in zip(rows, rows[1:]):
            assert (-a.score, a.vec_id) < (-b.score, b.vec_id)
        for r in rows:
            assert abs(r.score - x[ids.index(q)] @ x[ids.index(r.vec_id)]) < 1e-12
        hits += len({r.vec_id for r in rows} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_ties_bad_vectors_and_norms(spark):
    rng = np.random.default_rng(1)
    rows = [(i, list(map(float, v))) for i, v in enumerate(rng.normal(0, 1, (300, 6)) * rng.uniform(0.1, 5, (300, 1)))]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for i in range(200)] + [(1000, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0])]
    bad = [(2000, None), (2020, [0.0] * 6), (2040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2060, [float("nan")] * 6), (2080, [float("inf")] + [1.0] * 5), (2100, []), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 20 == 0, recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = dict(rows)
    ids = sorted(good)
    want = brute(ids, np.array([good[i] for i in ids]), [i for i in ids if i % 20 == 0])
    assert set(got) == set(want)
    same = [[i for _, i, _ in sorted(got[q])] == [i for i, _ in want[q]] for q in want]
    assert np.mean(same) > 0.9
    assert all([i for _, i, _ in sorted(got[q])] == [i for i, _ in want[q]] for q in want if q >= 1000)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 0.0])], [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [3.0])], [(1, [1.0])]])
def test_few_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("id") % 20 == 0, recall=1.0).collect()
    assert len(got) == (len(rows) - 1 if len(rows) > 1 else 0)


def test_many_functions():
    rng = np.random.default_rng(2)
    hasher = neighbours.Hasher(16, 2, 2, 1.0)
    x = rng.normal(size=(50, 16))
    u = hasher.unit(x / np.linalg.norm(x, axis=1)[:, None], True)
    for t in range(2):
        probes = hasher.probes(u, t, 10)
        assert (probes[:, 0] == hasher.buckets(u, t)).all() and all(len(set(p)) == 10 for p in probes.tolist())


def test_members_are_unit_vectors_and_angles_are_inner_products():
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 8, 63, 64):
        x = rng.normal(size=(40, size)) * rng.uniform(0.1, 3, (40, 1))
        largest = np.linalg.norm(x, axis=1).max()
        hasher = neighbours.Hasher(size, 1, 1, largest)
        members, asked = hasher.unit(x, True), hasher.unit(x, False)
        assert np.allclose(np.linalg.norm(members, axis=1), 1) and np.allclose(np.linalg.norm(asked, axis=1), 1)
        assert np.allclose(asked @ members.T * largest * np.linalg.norm(x, axis=1)[:, None], x @ x.T)
        axes = hasher.axes(members, 0, 0)
        assert np.allclose(np.linalg.norm(axes[:, : hasher.dim], axis=1), 1)  # the rotation keeps lengths


def test_hot_bucket_is_split_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x = np.array([1.0, 2.0, 3.0, 4.0]) + rng.normal(0, 0.01, (300, 4))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 2 == 0, recall=1.0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute(list(range(300)), x, range(0, 300, 2), k=5)
    same = [[i for _, i in sorted(got[q])] == [i for i, _ in want[q]] for q in want]
    assert set(got) == set(want) and np.mean(same) > 0.95


def test_probes_reach_the_recall():
    rng = np.random.default_rng(3)
    hasher = neighbours.Hasher(64, 1, 2, 1.0)
    x = rng.normal(size=(4, 64))
    near = [-v[None, :] / np.linalg.norm(v) for v in x]  # about the last of all buckets
    limit = neighbours._probe_limit(hasher, x, near, 1.0)
    probes = hasher.probes(hasher.unit(x, False), 0, limit)
    assert 4096 < limit <= (2 * hasher.dim) ** 2 and all(hasher.buckets(hasher.unit(v, True), 0)[0] in p for v, p in zip(near, probes))
