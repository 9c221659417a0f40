"""Sequence functions and operators: restated loops, conservation laws, edge reads."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.functions import hashes, sequence, slots
from strandlake.operators import counting, keyvalue, kmers
from strandlake.plans import keyvalue_queries
from strandlake.sources import keys
from strandlake.sources import reads as source
from strandlake.sources import sinks

MASK = 2**64 - 1
COMPLEMENT = str.maketrans("ACGT", "TGCA")


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")


def rc(s):
    return s[::-1].translate(COMPLEMENT)


# --- hashes
def test_quick_hash_golden_values():
    got = hashes.quick_hash_array(np.array([0, 1], np.uint64))
    assert got.tolist() == [8882115565503647203, 13738603025981410947]
    packed = hashes.packed_words(pd.Series(["ACGTACGTACGTTTT"]), 1)[:, 0]
    assert hashes.quick_hash_array(packed).tolist() == [14472754228853059324]


def murmur2(data, seed):
    m = 0xC6A4A7935BD1E995
    h = (seed ^ (len(data) * m)) & MASK
    for i in range(0, len(data), 8):
        k = int.from_bytes(data[i : i + 8], "little") * m & MASK
        k = (k ^ (k >> 47)) * m & MASK
        h = (h ^ k) * m & MASK
    h = (h ^ (h >> 47)) * m & MASK
    return h ^ (h >> 47)


def murmur3(data, seed):
    rot = lambda x, n: ((x << n) | (x >> (64 - n))) & MASK
    c1, c2, h1, h2 = 0x87C37B91114253D5, 0x4CF5AD432745937F, seed, seed
    words = [int.from_bytes(data[i : i + 8], "little") for i in range(0, len(data), 8)]
    while len(words) > 1:
        k1, k2, *words = words
        h1 = (rot(h1 ^ (rot(k1 * c1 & MASK, 31) * c2 & MASK), 27) + h2) * 5 + 0x52DCE729 & MASK
        h2 = (rot(h2 ^ (rot(k2 * c2 & MASK, 33) * c1 & MASK), 31) + h1) * 5 + 0x38495AB5 & MASK
    if words:
        h1 ^= rot(words[0] * c1 & MASK, 31) * c2 & MASK
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & MASK
    h2 = (h1 + h2) & MASK

    def final(h):
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ (h >> 33)) * c & MASK
        return h ^ (h >> 33)

    return (final(h1) + final(h2)) & MASK


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_murmur_against_plain_integers(n):
    rng = np.random.default_rng(n)
    words = rng.integers(0, 2**63, (20, n)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert hashes.murmur2_array(words, 42).tolist() == [murmur2(w.tobytes(), 42) for w in words]
    assert hashes.murmur3_array(words).tolist() == [murmur3(w.tobytes(), 313) for w in words]


def test_hash_columns(spark):
    df = spark.createDataFrame([(0,), (-1,), (2**62,)], "x long")
    got = [int(r[0]) for r in df.select(hashes.quick_hash("x")).collect()]
    assert got == hashes.quick_hash_array(np.array([0, -1, 2**62], np.int64).view(np.uint64)).tolist()


# --- functions
def test_scalar_functions(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    lit = F.lit
    assert [one(sequence.encode_base(lit(c))) for c in "ACGTNacgt"] == [0, 1, 2, 3, 2, 0, 1, 2, 3]
    assert [one(sequence.encode_base_strict(lit(c))) for c in "ACGTNa"] == [0, 1, 2, 3, None, 0]
    kmer = "GATTACAGATTACAGATTACAGATTACAGAT"
    assert one(sequence.unpack(sequence.pack(lit(kmer)), 31)) == kmer and one(sequence.pack(lit("T" * 31))) == 4**31 - 1
    assert one(sequence.pack_limbs(lit("A" * 31 + "C"))) == [0, 1]
    assert one(sequence.kmers(lit("ACGTA"), 3)) == ["ACG", "CGT", "GTA"] and one(sequence.kmers(lit("AC"), 3)) == []
    assert [one(sequence.complement_iupac(lit(c))) for c in "ACGTN0RUx"] == ["T", "G", "C", "A", "N", "0", "N", "N", ""]
    assert one(sequence.unpack_extensions(sequence.pack_extensions(lit("T"), lit("G")))).asDict() == {"left": "T", "right": "G"}
    assert one(sequence.pack_extensions(lit("?"), lit("A"))) == 1 and one(sequence.unpack_extensions(lit(6))) is None
    assert one(sequence.pack4(lit("_aT?N"))) == "018b90" and one(sequence.unpack4(lit("018b90"), lit(5))) == "_aT?N"
    assert [sequence.minimizer_length(k) for k in (15, 21, 31, 55, 99)] == [15, 15, 21, 27, 27]
    with pytest.raises(ValueError):
        sequence.minimizer_length(14)


def test_minimizer_is_strand_invariant(spark):
    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACGT") for _ in range(21)) for _ in range(100)]
    df = frame(spark, seqs).select("seq", sequence.minimizer(F.col("seq"), 21, 15).alias("m"), sequence.minimizer(sequence.revcomp(F.col("seq")), 21, 15).alias("r"))
    for r in df.collect():
        best = max(min(r.seq[i : i + 15], rc(r.seq[i : i + 15])) for i in range(7))
        assert r.m == r.r == best


# --- operators
EDGE = ["", "A" * 21, "A" * 22, "ACGTACGTACGTACGTACGTACG", "A" * 60, "T" * 60, "ACGT" * 20]


def occurrences(seqs, k):
    return [(i, p, s[p : p + k], s[p - 1], s[p + k]) for i, s in enumerate(seqs) for p in range(1, len(s) - k)]


def test_interior_kmers_of_edge_reads(spark):
    rng = random.Random(1)
    seqs = EDGE + ["".join(rng.choice("ACGT") for _ in range(rng.randrange(120))) for _ in range(40)]
    got = kmers.interior_kmers(frame(spark, seqs), 21, with_rc=True).collect()
    assert sorted((r.read_id, r.pos, r.kmer, r.left, r.right) for r in got) == sorted(occurrences(seqs, 21))
    assert all(r.rc == rc(r.kmer) for r in got)


def test_canonical_counts_do_not_see_the_strand(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACGT") for _ in range(80)) for _ in range(30)] + ["ACGT" * 15]
    rows = lambda s: sorted(map(tuple, counting.counted(kmers.canonical_kmers(frame(spark, s), 21)).collect()))
    assert rows(seqs) == rows([rc(s) if i % 2 else s for i, s in enumerate(seqs)])
    # palindromes (even k) keep their extensions
    assert sum(r.cnt for r in counting.counted(kmers.canonical_kmers(frame(spark, ["ACGT" * 8]), 20)).collect()) == 32 - 21


def islands(seq, k, target):
    out, start = [], None
    for p in range(1, len(seq) - k):
        if start is None or target[p] != target[p - 1]:
            if start is not None:
                out.append((target[p - 1], start - 1, seq[start - 1 : p + k]))
            start = p
    if start is not None:
        out.append((target[len(seq) - k - 1], start - 1, seq[start - 1 :]))
    return out


def test_supermers_against_a_loop(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(20, 200))) for _ in range(25)]
    target = {}
    for r in kmers.with_target(kmers.interior_kmers(frame(spark, seqs), 21), 21, 5, 15).collect():
        target.setdefault(r.read_id, {})[r.pos] = r.target
    want = sorted((i, *x) for i, s in enumerate(seqs) if i in target for x in islands(s, 21, target[i]))
    assert sorted(tuple(r) for r in kmers.supermers(frame(spark, seqs), 21, 5, 15).collect()) == want


def test_stretches_of_long_reads(spark):
    rng = random.Random(4)
    letters = lambda n, of="ACGT": "".join(rng.choice(of) for _ in range(n))
    seqs = ["A" * 500, letters(700), letters(300) + "A" * 300 + letters(300), letters(22), letters(23), letters(24), "", letters(600, "ACGTacgtNn" + "ACGT" * 20), "N" * 90, letters(90) + "N" * 5 + letters(90)]
    for clean_only, df in ((False, frame(spark, seqs[:7])), (True, frame(spark, seqs))):
        rows = lambda x: sorted(map(tuple, x.collect()))
        for make in (kmers.supermers, kmers.placed):
            want = rows(make(df, 21, 7, 15, clean_only))
            assert want and rows(make(df, 21, 7, 15, clean_only, stretch=50)) == want and rows(make(df, 21, 7, 15, clean_only, stretch=37)) == want


def test_placed_is_the_minimizer_of_each_kmer(spark):
    rng = random.Random(5)
    df = frame(spark, ["".join(rng.choice("ACGT") for _ in range(rng.randrange(20, 120))) for _ in range(20)])
    each = kmers.interior_kmers(df, 21)
    text = kmers.with_target(kmers.with_minimizer(each, 21, 15), 21, 6, 15)
    plain = sequence.minimizer(F.col("kmer"), 21, 15)
    want = sorted((r.read_id, r.pos, r.code, r.target) for r in text.where(F.col("minimizer") == plain).select("read_id", "pos", sequence.pack(F.col("minimizer")).alias("code"), "target").collect())
    assert len(want) == each.count() and sorted(map(tuple, kmers.placed(df, 21, 6, 15).collect())) == want
    udf = text.select("target", hashes.minimizer_target(6)("minimizer").alias("t")).collect()
    assert all(r.target == r.t for r in udf)


def test_split_targets_add_up(spark):
    rng = random.Random(6)
    df = frame(spark, ["A" * 150 for _ in range(40)] + ["".join(rng.choice("ACGT") for _ in range(150)) for _ in range(40)] * 2)
    s = kmers.supermers(df, 21, 8, 15)
    loads = s.groupBy("target").agg(F.sum(F.length("seq") - 22).alias("load"))
    parts = counting.counted(kmers.expanded(kmers.routed(s, loads, even=1.0).drop("read_id", "offset"), 21), "target", "salt", "split")
    assert parts.where("split").count() > 0
    want = counting.counted(kmers.interior_kmers(df, 21))
    assert sorted(map(tuple, counting.added(parts).collect())) == sorted(map(tuple, want.collect()))


def test_masked_windows(spark):
    body = "ACGTTGCATGCCATTGACGTA"
    seqs = ["C" + body + "G", "c" + body + "G", "N" + body + "G", "n" + body + "G", "C" + body[:5] + "N" + body[6:] + "G", "C" + body.lower() + "G"]
    got = {(r.read_id, r.kmer, r.left, r.right) for r in kmers.masked_kmers(frame(spark, seqs), 21).collect()}
    swap = rc(body) < body
    mine = lambda left, right: (right.translate(COMPLEMENT), left.translate(COMPLEMENT)) if swap else (left, right)
    key = min(body, rc(body))
    assert got == {(0, key, *mine("C", "G")), (1, key, *mine("0", "G")), (3, key, *mine("0", "G")), (5, key, *mine("C", "G"))}
    assert {r.read_id for r in kmers.masked_kmers(frame(spark, seqs), 21, reject_low_quality=True).collect()} == {0, 5}


def plain_call(t):
    return max(zip(t, "ACGT"))[1]


def depth_call(t, cnt):
    (n, base), (second, _) = sorted(zip(t, "ACGT"), reverse=True)[:2]
    least = max(2, int((1.0 - 0.9) * cnt))
    return "X" if n < least else "F" if second >= least else base


def test_calls_against_loops(spark):
    rng = random.Random(5)
    rows = [(str(i), rng.randrange(1, 60), *[rng.choice([0, 0, 1, 2, 3, 5, 30]) for _ in range(8)]) for i in range(400)]
    df = spark.createDataFrame(rows, "kmer string, cnt long, " + ", ".join(f"{v} long" for v in counting.VOTES))
    for depth, call in ((None, lambda t, c: plain_call(t)), (0.9, depth_call)):
        got = {r.kmer: (r.left, r.right) for r in counting.called(df, depth).collect()}
        assert got == {k: (call(x[:4], c), call(x[4:], c)) for k, c, *x in rows}


def test_merge_rules(spark):
    schema = "kmer string, cnt long, " + ", ".join(f"{v} long" for v in counting.VOTES)
    clear, fork = [9, 0, 0, 0, 0, 9, 0, 0], [5, 5, 0, 0, 0, 9, 0, 0]
    reads = spark.createDataFrame([("a", 9, *clear), ("b", 10, *fork)], schema)
    contigs = spark.createDataFrame([("a", 3, *[3, 0, 0, 0, 0, 0, 3, 0]), ("b", 3, *[0, 3, 0, 0, 0, 3, 0, 0]), ("c", 3, *[0, 3, 0, 0, 0, 3, 0, 0]), ("d", 3, *[3, 3, 0, 0, 0, 3, 0, 0])], schema)
    got = {r.kmer: (r.cnt, r.origin) for r in counting.merged(reads, contigs).collect()}
    assert got == {"a": (9, "kept"), "b": (3, "replaced"), "c": (3, "added")}


# --- sources and sinks
def test_genome_file_and_reads(spark, tmp_path):
    rng = random.Random(6)
    lines = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 70))) for _ in range(300)]
    (tmp_path / "g.txt").write_text(">name\n" + "\n".join(lines) + "\n")
    got = sorted((r.offset, r.bases) for r in source.read_genome(spark, str(tmp_path / "g.txt"), strip_fasta_header=True).collect())
    assert "".join(b for _, b in got) == "".join(lines) and [o for o, _ in got][:3] == [0, len(lines[0]), len(lines[0]) + len(lines[1])]
    chunks = spark.createDataFrame([(i, "".join(lines)[32 * i : 32 * i + 32]) for i in range(100)], "chunk long, bases string")
    starts = spark.createDataFrame([(i, rng.randrange(3000)) for i in range(50)], "read_id long, start long")
    for r in source.cut_reads(chunks, starts, 100).collect():
        assert r.seq == "".join(lines)[r.start : r.start + 100]
    parts = source.partitions(spark, 103, 10, 4).orderBy("target").collect()
    assert [(r.start, r.portion, r.n_reads) for r in parts] == [(0, 26, 3), (26, 26, 3), (52, 26, 2), (78, 25, 2)]
    low = source.fastq_like(spark.createDataFrame([("ACGT", "I!I!")], "seq string, q string"), "seq", "q").first().seq
    assert low == "AcGt"


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    sinks.append_timing(spark, path, 10, 100, 21, 1.5)
    sinks.append_timing(spark, path, 20, 100, 21, 2.5)
    assert sorted(r["Num reads"] for r in sinks.read_timings(spark, path).collect()) == [10, 20]
    sinks.write_series(spark.createDataFrame([(1, 2.0)], "x int, y double"), str(tmp_path / "s"))
    sinks.write_kmers(spark.createDataFrame([("AAA", 2, "C", "G")], "kmer string, count long, left string, right string"), str(tmp_path / "k"), 2)
    assert spark.read.parquet(str(tmp_path / "k")).count() == 1


# --- keyed tables
def test_keyed_tables(spark):
    pairs = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "key long, val long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(keyvalue.remove_one(pairs, spark.createDataFrame([(1,), (3,)], "key long"))) == [(1, 11), (2, 20)]
    assert rows(keyvalue.append(pairs, spark.createDataFrame([(5,)], "key long"))) == [(1, 10), (1, 11), (2, 20), (5, 0)]
    more = spark.createDataFrame([(2, 9, 1), (7, 8, 3), (7, 6, 2)], "key long, val long, seq long")
    assert rows(keyvalue.insert_if_absent(pairs, more)) == [(1, 10), (1, 11), (2, 20), (7, 6)]
    assert [r.found for r in keyvalue.toggle_log(more).orderBy("key", "seq").collect()] == [False, False, True]
    assert rows(keyvalue.toggled(more)) == [(2, 9)]
    full = keyvalue.bounded_filter(spark.range(3000).selectExpr("id as key", "id as seq"), 16, 8, 10, 2).collect()
    assert all(r.kept <= 128 and 60 < r.first_refused < 200 for r in full)


def test_bounded_filter_against_a_loop(spark):
    def murmur(key, seed, m=0xC6A4A7935BD1E995, whole=2**64):
        k = key * m % whole
        k = (k ^ (k >> 47)) * m % whole
        h = (seed ^ (8 * m % whole) ^ k) * m % whole
        h = (h ^ (h >> 47)) * m % whole
        return h ^ (h >> 47)

    shards, buckets, size, bits = 3, 16, 8, 10
    placed = spark.range(700).selectExpr("id", f"cast(pmod(xxhash64(id), {shards}) as int) as shard").orderBy("id").collect()
    want = {s: [0, 0, -1, [0] * buckets] for s in range(shards)}
    for key, shard in placed:
        h, state = murmur(key, 1), want[shard]
        first, second = (h >> bits) % buckets, ((h >> bits) ^ ((h & 1023) * 0x5BD1E995 % 2**64)) % buckets
        at = second if state[3][first] >= size * 3 / 4 and state[3][second] < state[3][first] else first
        if state[3][at] < size:
            state[3][at] += 1
            state[1] += 1
        elif state[2] < 0:
            state[2] = state[0]
        state[0] += 1
    got = keyvalue.bounded_filter(spark.range(700).selectExpr("id as key", "id as seq"), buckets, size, bits, shards).collect()
    assert {r.shard: [r.tried, r.kept, r.first_refused] for r in got} == {s: x[:3] for s, x in want.items()}


def test_median_key(spark):
    for n, step in [(0, 1), (1, 1), (2, 1), (3, 5), (101, 1), (5000, 977)]:
        keys_ = [i * step - 40 for i in range(n)]
        pairs = spark.createDataFrame([(k, 0) for k in keys_], "key long, val long")
        cut = keyvalue_queries._median_key(pairs, cells=4)
        assert [k for k in keys_ if k <= cut] == keys_[: n // 2]


def test_slots(spark):
    slot = spark.range(1).select(slots.pack_slot(F.lit(1023), F.lit(65), 6).alias("s"))
    r = slot.select(slots.slot_tag(F.col("s"), 6), slots.slot_value(F.col("s"), 6), slots.is_tombstone(F.col("s"), 10, 6), slots.is_empty(F.col("s"), 6)).first()
    assert tuple(r) == (1023, 1, True, False)
    # either bucket leads to the other by the tag
    r = spark.range(1).select(slots.xor_choices(F.lit(987654321).cast("long"), 10, 1 << 62).alias("x")).first().x
    assert r[0] ^ r[1] == (987654321 & 1023) * slots.TAG_FACTOR


def test_sizes():
    ladder = slots.prime_ladder(limit=10**6)
    assert ladder[:4] == [2, 3, 5, 7] and all(slots.is_prime(p) for p in ladder) and not slots.is_prime(3215031751)
    assert all(b <= a * 1.05 + 120 for a, b in zip(ladder, ladder[1:]))
    assert slots.prime_capacity(1000, ladder) >= 1000 >= slots.prime_capacity(1000, ladder, below=True)
    assert slots.expected_kmers(1_000_000, 100, 31, 2) == 35_000_000 and slots.table_slots(660) == (1000, 858)
    assert slots.filter_bytes(100) == 240 and slots.level_sizes(100) == [90, 10]


def test_key_files(spark, tmp_path):
    x = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 1000)
    (tmp_path / "keys.bin").write_bytes(x.astype("<i8").tobytes())
    got = keys.read_keys(spark, str(tmp_path / "keys.bin"), chunk=300).orderBy("pos").collect()
    assert [r.key for r in got] == x.tolist() and [r.pos for r in got] == list(range(1000))
    assert keys.random_pairs(spark, 50).select("key").distinct().count() == 50


def test_n_as_g(spark):
    assert kmers.n_as_g(frame(spark, ["aCNt"])).first().seq == "ACGT"
