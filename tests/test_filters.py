"""Bounded tables against a plain loop, the command line, reads of each target's own part."""

import random

import pytest

from strandlake import __main__ as cli
from strandlake.operators import filters
from strandlake.sources import reads


def murmur(key, seed, m=0xC6A4A7935BD1E995, whole=2**64):
    k = key % whole * m % whole
    k = (k ^ (k >> 47)) * m % whole
    h = (seed ^ (8 * m % whole) ^ k) * m % whole
    h = (h ^ (h >> 47)) * m % whole
    return h ^ (h >> 47)


def made_events(n=1500, keys=260):
    rng = random.Random(3)
    return [(rng.randrange(-20, keys), i, rng.choice(filters.OPS), rng.randrange(64)) for i in range(n)]


def loop(events, shape):
    """Slots in flat arrays: 0 is empty, -1 removed."""
    size, tables = shape.bucket_size, [[0] * shape.buckets * shape.bucket_size, [0] * shape.backing * shape.bucket_size]
    ids, out = {}, {}

    def cells(t, b):
        return range(b * size, (b + 1) * size)

    def live(t, b):
        return sum(tables[t][c] not in (0, -1) for c in cells(t, b))

    for key, seq, op, val in events:
        h = murmur(key, shape.seed)
        tag = min(max(h % 2**shape.tag_bits, 1), 2**shape.tag_bits - 2) if shape.tag_bits else 0
        mark, at = (tag if shape.tag_bits else ("key", key)), h // 2**shape.tag_bits
        main = [(at + i) % shape.buckets for i in range(min(shape.probes, shape.buckets))] if shape.choose == "first" else [at % shape.buckets, (at ^ tag) % shape.buckets]
        back = [(h + i) % shape.backing for i in range(min(shape.backing_probes, shape.backing))]
        hit = None
        for t, places in ((0, main), (1, back)):
            for b in places:
                hit = hit or next(((t, c) for c in cells(t, b) if tables[t][c] not in (0, -1) and tables[t][c][0] == mark), None)
                if hit or (t == 1 and live(t, b) != size) or (t == 0 and shape.choose == "first" and any(tables[t][c] == 0 for c in cells(t, b))):
                    break
            if hit:
                break
        if op != "insert" and hit:
            t, c = hit
            out[seq] = (True, True, tables[t][c][1])
            if op in ("remove", "toggle"):
                tables[t][c] = -1
            continue
        if op in ("query", "remove"):
            out[seq] = (False, False, None)
            continue
        if shape.choose == "first":
            order = main
        else:
            early = [b for b in main if shape.choose == "shortcut" and live(0, b) < size * 0.75]
            order = early + sorted([b for b in main if b not in early], key=lambda b: live(0, b))
        free = [(t, c) for t, places in ((0, order), (1, back)) for b in places for c in cells(t, b) if tables[t][c] == 0 or (shape.reuse and tables[t][c] == -1)]
        if free:
            t, c = free[0]
            tables[t][c] = (mark, val)
        out[seq] = (bool(free), False, None)
    return out


@pytest.mark.parametrize("choose", ["shortcut", "least", "first"])
@pytest.mark.parametrize("reuse, backing, tag_bits", [(True, 0, 5), (False, 3, 10), (True, 3, 5)])
def test_replay_against_a_loop(spark, choose, reuse, backing, tag_bits):
    events = made_events()
    shape = filters.Shape(6, 8, choose, 2, tag_bits, reuse, backing, 2)
    df = spark.createDataFrame(events, "key long, seq long, op string, val long").repartition(3)
    got = {r.seq: (r.done, r.found, r.got) for r in filters.replayed(df, shape, 1).collect()}
    assert got == loop(events, shape)
    assert any(not d for (_, s, op, _) in events if op == "insert" for d in [got[s][0]])  # the table does get full


def test_whole_keys_are_a_map(spark):
    held, want = {}, {}
    events = [e for e in made_events() if e[2] != "insert"]
    for key, seq, op, val in events:
        found, got = key in held, held.get(key)
        want[seq] = (found or op not in ("query", "remove"), found, got)
        if found and op in ("remove", "toggle"):
            del held[key]
        elif not found and op in ("insert_or_get", "toggle"):
            held[key] = val
    df = spark.createDataFrame(events, "key long, seq long, op string, val long")
    got = filters.replayed(df, filters.Shape(64, choose="first", tag_bits=0), 3).collect()
    assert {r.seq: (r.done, r.found, r.got) for r in got} == want


def test_replay_edges(spark):
    rows = [(None, 1, "insert", 1), (1, None, "insert", 1), (1, 2, None, 1), (1, 3, "other", 1), (1, 4, "insert", None), (1, 5, "query", None), (1, 5, "query", None)]
    df = spark.createDataFrame(rows, "key long, seq long, op string, val long")
    got = sorted((r.seq, r.done, r.got) for r in filters.replayed(df, filters.Shape(4), 2).collect() if r.got is not None)
    assert got == [(5, True, 0), (5, True, 0)]
    assert filters.replayed(df.where("false"), filters.Shape(4), 2).count() == 0
    for wrong in ({"choose": "any"}, {"tag_bits": 0}):
        with pytest.raises(ValueError):
            filters.Shape(4, **wrong)


def test_chunks_of_a_genome_file(spark, tmp_path):
    rng = random.Random(5)
    lines = ["".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 7, 32, 70, 200]))) for _ in range(60)]
    (tmp_path / "genome.txt").write_text("\n".join(lines) + "\n")
    genome = "".join(lines)
    chunks = reads.chunked(reads.read_genome(spark, str(tmp_path / "genome.txt")))
    got = [r.bases for r in chunks.orderBy("chunk").collect()]
    assert got == [genome[i : i + 32] for i in range(0, len(genome), 32)]
    simulated = cli.simulate(spark, str(tmp_path / "genome.txt"), 90, 40, 4)
    assert simulated.count() == 90 and all(genome[r.start : r.start + 40] == r.seq for r in simulated.collect())


def test_starts_stay_in_their_part(spark):
    length, n, size, targets = 1003, 42, 50, 4
    part = {r.target: r for r in reads.partitions(spark, length, n, targets).collect()}
    rows = reads.rank_starts(spark, length, n, size, targets).collect()
    assert all(part[r.target].start <= r.start <= part[r.target].start + part[r.target].portion - size for r in rows)
    assert {t: sum(r.target == t for r in rows) for t in part} == {t: p.n_reads for t, p in part.items()}
    assert reads.rank_starts(spark, length, 3, size, targets).count() == 3 and reads.rank_starts(spark, length, 0, size, targets).count() == 0
    with pytest.raises(ValueError):
        reads.rank_starts(spark, 100, 5, 50, 4)


def test_command_line(spark, tmp_path, capsys):
    rng = random.Random(6)
    genome = "".join(rng.choice("ACGT") for _ in range(900))
    (tmp_path / "genome.txt").write_text("\n".join(genome[i : i + 70] for i in range(0, 900, 70)))
    cli.main([str(tmp_path / "genome.txt"), "60", "80", "21", str(tmp_path / "times"), "--targets", "3"])
    printed = capsys.readouterr().out
    counts = [int(line.split("total count ")[1].split(",")[0]) for line in printed.splitlines() if line.startswith("target")]
    assert sum(counts) == 60 * (80 - 22) and "counting time" in printed
    times = spark.read.option("header", True).csv(str(tmp_path / "times"))
    assert times.count() == 1 and times.first()["Num reads"] == "60"
