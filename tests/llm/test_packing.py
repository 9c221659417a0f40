"""Packing: an exact round trip against the tokenizer, full sequences, balanced groups."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strandlake.llm.packing import Packer, pack
from strandlake.llm.queries import op1_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "It's 12,345 naïve Straße — “quoted” x", "a<|endoftext|>b <|startoftext|> c <|x", "é ́a \x1c\x1d x\x85y", "İI ΑΣ ΣΑΣ",
    "tab\tnew\nline\r\x0b\x0c end", "word " * 9000, "x" * 30000, "日本語テキスト 한국어 \U0001f600‍\U0001f600 can't we'll",
]


def check(rows, texts):
    """texts: (id, text) of every row; pieces of equal documents may be mixed up, so ids are unique here."""
    tok = Tokenizer.from_file(PATH)
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts}
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(docs) == set(want)
    for i, pieces in docs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[i])
            at += r.length
            assert zlib.crc32(np.array(want[i][r.start : at], "<u4").tobytes()) == r.ids_crc32
        assert at == len(want[i])
    groups = defaultdict(int)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0 and at == pieces[0].tier
        groups[pieces[0].step_group] += at
    assert max(groups.values()) <= 65536


def test_documents(spark):
    rows = op1_packing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_texts(spark, tmp_path):
    data = [(i, t, "x") for i, t in enumerate(ODD)]
    spark.createDataFrame(data, "doc_id long, text string, start string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    check(op1_packing(spark, str(tmp_path)).collect(), [(i, t) for i, t, _ in data])


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    rows = pack(df, PATH).collect()
    assert sum(r.length for r in rows) == 3 + 3 + 3 + 1 and sum(r.length for r in rows if r.doc_id is None) == 3
    assert pack(df.limit(0), PATH).collect() == []


def test_packer_fills_windows():
    rng = np.random.default_rng(1)
    packer, total, used = Packer((4, 8, 16)), 0, 0
    documents = [(i, np.zeros(int(n), np.uint32)) for i, n in enumerate(rng.integers(0, 50, 300))]
    total = sum(len(d) for _, d in documents)
    for tier, pieces in [*packer.add(documents), *packer.windows(), *packer.rest()]:
        assert sum(n for *_, n in pieces) == tier
        used += tier
    assert used == total
