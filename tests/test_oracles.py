"""Every query of the sequence engine against its DuckDB SQL on the smallest tables."""

import glob
import os
import random
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandlake.plans import registry

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


#: Queries on N and lower case: the smallest tables hold hardly any such k-mers, so they are tested on made reads too.
DIRTY = ["kmer_counts_n_as_g", "kmer_uu_masked", "pack4_roundtrip", "pack4_slice", "quality_masked_ext", "supermers_masked", "valid_kmers"]


def views(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module")
def duck():
    return views(SF)


@pytest.fixture(scope="module")
def dirty(tmp_path_factory):
    """Documents that are reads of both strands of a genome, with lower case, N and the edge reads."""
    rng, folder = random.Random(7), tmp_path_factory.mktemp("dirty")
    genome = "".join(rng.choice("ACGT") for _ in range(3000))
    back = genome[::-1].translate(str.maketrans("ACGT", "TGCA"))
    texts = []
    for _ in range(400):
        strand, start, n = rng.choice([genome, back]), rng.randrange(2900), rng.randrange(15, 160)
        texts.append("".join("N" if rng.random() < 0.004 else "n" if rng.random() < 0.002 else c.lower() if rng.random() < 0.03 else c for c in strand[start : start + n]))
    texts += ["", "A" * 60, "N" * 50, genome[:21], genome[:22], genome[:23], "N" + genome[:22], genome[:22] + "N", "n" + genome[:22], "ACGT" * 12]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), f"{folder}/documents.parquet")
    return str(folder)


def same_rows(spark, con, name, folder):
    got, want = registry.QUERIES[name](spark, folder), con.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert {c: KINDS[t] for c, t in got.dtypes} == {c: str(t) for c, t in zip(want.columns, want.types, strict=True)}
    rows = Counter(tuple(r[c] for c in columns) for r in got.collect())
    assert rows == Counter(want.select(*[f'"{c}"' for c in columns]).fetchall()) and rows
    return rows


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - {"kmer_uu_masked"}))
def test_same_rows(spark, duck, name):
    same_rows(spark, duck, name, SF)


@pytest.mark.parametrize("name", DIRTY)
def test_same_rows_of_dirty_reads(spark, dirty, name):
    assert sum(same_rows(spark, views(dirty), name, dirty).values()) > 100


@pytest.mark.parametrize("name", ["kmer_uu_table", "kmer_uu_masked"])
def test_very_common_kmer(spark, tmp_path, name):
    """A k-mer seen over 655,350 times: a tenth of its count is more than a vote cap of 65,535 leaves."""
    texts = ["A" * 1024] * 660 + ["C" + "ACGGT" * 30] * 3
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), f"{tmp_path}/documents.parquet")
    rows = same_rows(spark, views(tmp_path), name, str(tmp_path))
    assert any(65_535 in r and "A" * 21 in r for r in rows)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_others_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_sawtooth_looks_up(spark, monkeypatch):
    from strandlake.operators import keyvalue as kv

    append = kv.append
    monkeypatch.setattr(kv, "append", lambda pairs, more: append(pairs, more.where("key % 3 <> 0")))  # a table that loses keys
    rows = registry.QUERIES["filter_sawtooth"](spark, SF).collect()
    assert len(rows) == 6 and all(r.misses > 0 for r in rows)
