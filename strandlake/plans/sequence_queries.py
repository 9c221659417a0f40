"""Queries on reads and k-mers, over whole tables and whole texts, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashes, sequence
from ..operators import counting, kmers
from ..sources import reads as source
from .registry import query

K, M, TARGETS = 21, 15, 4

# --- fragments of SQL; each is a common table expression
READS = "reads AS (SELECT doc_id AS read_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS seq FROM documents)"
DIRTY = "reads AS (SELECT doc_id AS read_id, regexp_replace(text, '[^ACGTNacgtn]', '', 'g') AS seq FROM documents)"
POSITIONS = f"places AS (SELECT read_id, seq, unnest(range(1, length(seq) - {K})) AS pos FROM reads WHERE length(seq) >= {K + 2})"
OCC = f"occ AS (SELECT read_id, pos, substr(seq, pos + 1, {K}) AS kmer, substr(seq, pos, 1) AS l, substr(seq, pos + {K + 1}, 1) AS r FROM places)"
RC = "rcs AS (SELECT *, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc FROM occ)"
CANON = (
    "canon AS (SELECT read_id, pos, least(kmer, rc) AS kmer, "
    "CASE WHEN rc < kmer THEN translate(r, 'ACGT', 'TGCA') ELSE l END AS l, CASE WHEN rc < kmer THEN translate(l, 'ACGT', 'TGCA') ELSE r END AS r FROM rcs)"
)
MASKED = (
    "occ AS (SELECT read_id, pos, upper(kmer) AS kmer, CASE WHEN l SIMILAR TO '[acgtn]' THEN '0' ELSE l END AS l, CASE WHEN r SIMILAR TO '[acgtn]' THEN '0' ELSE r END AS r "
    "FROM raw WHERE regexp_full_match(kmer, '[ACGTacgt]+') AND l <> 'N' AND r <> 'N')"
)
RAW = OCC.replace("occ AS", "raw AS", 1)


def _votes(weight: str = "1") -> str:
    return ", ".join(f"CAST(sum(CASE WHEN {c} = '{b}' THEN {weight} ELSE 0 END) AS BIGINT) AS {c}_{b.lower()}" for c in "lr" for b in "ACGT")


FORWARD = f"WITH {READS}, {POSITIONS}, {OCC}, counts AS (SELECT kmer, count(*) AS cnt, {_votes()} FROM occ GROUP BY kmer)"
COUNTS = f"WITH {READS}, {POSITIONS}, {OCC}, {RC}, {CANON}, counts AS (SELECT kmer, count(*) AS cnt, {_votes()} FROM canon GROUP BY kmer)"
ANY_VOTE = "l_a + l_c + l_g + l_t + r_a + r_c + r_g + r_t > 0"


def _listed(side: str) -> str:
    return f"list_reverse_sort([{{'n': {side}_a, 'b': 'A'}}, {{'n': {side}_c, 'b': 'C'}}, {{'n': {side}_g, 'b': 'G'}}, {{'n': {side}_t, 'b': 'T'}}])"


def _depth_call(side: str) -> str:
    least = "greatest(CAST(trunc((1.0::DOUBLE - 0.9::DOUBLE) * cnt) AS BIGINT), 2)"
    return f"CASE WHEN {_listed(side)}[1].n < {least} THEN 'X' WHEN {_listed(side)}[2].n >= {least} THEN 'F' ELSE {_listed(side)}[1].b END"


CALLS = f"calls AS (SELECT kmer, cnt AS count, {_depth_call('l')} AS \"left\", {_depth_call('r')} AS \"right\" FROM counts WHERE cnt >= 2 AND {ANY_VOTE})"


def _minimizer(of: str, m: int = M) -> str:
    return f"list_max(list_transform(range(1, {K - m + 2}), lambda i: least(substr({of}, i, {m}), substr(reverse(translate({of}, 'ACGT', 'TGCA')), {K - m + 2} - i, {m}))))"


def _unsigned_quick(v: str) -> str:
    """quick_hash as nested expressions of UHUGEINT modulo 2^64."""
    mod = "18446744073709551616::UHUGEINT"
    u = lambda x: f"(({x})::UHUGEINT)"
    start = f"(({u(v)} * 3935559000370003845::UHUGEINT + 2691343689449507681::UHUGEINT) % {mod})"
    steps = [("r", 21), ("l", 37), ("r", 4), ("m", 4768777513237032717), ("l", 20), ("r", 41), ("l", 5)]
    out, n = [f"q0 AS (SELECT *, {start} AS v FROM hashing)"], 0
    for kind, x in steps:
        n += 1
        if kind == "m":
            e = f"(v * {x}::UHUGEINT) % {mod}"
        elif kind == "r":
            e = f"xor(v, v // {2**x}::UHUGEINT)"
        else:
            e = f"xor(v, (v * {2**x}::UHUGEINT) % {mod})"
        out.append(f"q{n} AS (SELECT * EXCLUDE (v), ({e})::UHUGEINT AS v FROM q{n - 1})")
    return ", ".join(out) + f", hashed AS (SELECT * FROM q{n})"


WRAP = "18446744073709551616::UHUGEINT"


def _times(a: str, b: int) -> str:
    return f"(({a} * {b}::UHUGEINT) % {WRAP})"


def _rows_with(source: str, steps: list[tuple[str, str]]) -> str:
    """CTEs that add a column at a time to the rows of ``source``; the last one is ``hashed``."""
    names = [source, *[f"{source}_{i}" for i in range(1, len(steps))], "hashed"]
    return ", ".join(f"{new} AS (SELECT *, ({e})::UHUGEINT AS {column} FROM {old})" for old, new, (column, e) in zip(names[:-1], names[1:], steps, strict=True))


def _murmur3_steps(x: str, out: str) -> list[tuple[str, str]]:
    """The low half of the 128-bit x64 variant over one word, seed 313."""
    steps = [("a", _times(f"{x}::UHUGEINT", 0x87C37B91114253D5)), ("b", _times(f"((a * {2**31}::UHUGEINT) % {WRAP} + a // {2**33}::UHUGEINT)", 0x4CF5AD432745937F))]
    steps += [("c", f"(xor(xor({313}::UHUGEINT, b), 8::UHUGEINT) + {313 ^ 8}::UHUGEINT) % {WRAP}"), ("d", f"(c + {313 ^ 8}::UHUGEINT) % {WRAP}")]
    for h in "cd":
        steps += [(h + "1", _times(f"xor({h}, {h} // {2**33}::UHUGEINT)", 0xFF51AFD7ED558CCD)), (h + "2", _times(f"xor({h}1, {h}1 // {2**33}::UHUGEINT)", 0xC4CEB9FE1A85EC53))]
    return [*steps, (out, f"(xor(c2, c2 // {2**33}::UHUGEINT) + xor(d2, d2 // {2**33}::UHUGEINT)) % {WRAP}")]


def _murmur2_steps(x: str, seed: int, out: str) -> list[tuple[str, str]]:
    """The 64-bit A variant over one word."""
    m, r = 0xC6A4A7935BD1E995, f"{2**47}::UHUGEINT"
    start = seed ^ (8 * m % 2**64)
    steps = [("e", _times(f"{x}::UHUGEINT", m)), ("f", _times(f"xor(e, e // {r})", m)), ("g", _times(f"xor({start}::UHUGEINT, f)", m)), ("h", _times(f"xor(g, g // {r})", m))]
    return [*steps, (out, f"xor(h, h // {r})")]


def _left_aligned(of: str, m: int) -> str:
    code = f"list_reduce(list_transform(range(1, {m + 1}), lambda i: (instr('ACGT', substr({of}, i, 1)) - 1)::UHUGEINT), lambda a, b: a * 4 + b)"
    return f"(({code}) * {4 ** (32 - m)}::UHUGEINT)"


def _targets(reads: str = READS, occ: str = OCC, m: int = M) -> str:
    """occurrences with their minimizer's target."""
    return (
        f"WITH {reads}, {POSITIONS}, {occ}, least_ AS (SELECT *, {_minimizer('kmer', m)} AS minimizer FROM occ), "
        f"mins AS (SELECT DISTINCT minimizer FROM least_), hashing AS (SELECT minimizer, {_left_aligned('minimizer', m)} AS x FROM mins), "
        + _unsigned_quick("x")
        + f", placed AS (SELECT o.*, CAST(h.v % {TARGETS} AS INTEGER) AS target FROM least_ o JOIN hashed h USING (minimizer))"
    )


ISLANDS = (
    ", marked AS (SELECT read_id, pos, target, CASE WHEN lag(target) OVER w = target AND pos - lag(pos) OVER w = 1 THEN 0 ELSE 1 END AS fresh FROM placed WINDOW w AS (PARTITION BY read_id ORDER BY pos)), "
    "islands AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id ORDER BY pos) AS island FROM marked), "
    "runs AS (SELECT read_id, island, any_value(target) AS target, min(pos) AS first_, max(pos) AS last_ FROM islands GROUP BY read_id, island), "
    f"supers AS (SELECT read_id, target, first_ - 1 AS off, substr(seq, first_, last_ - first_ + {K + 2}) AS seq FROM runs JOIN reads USING (read_id))"
)


# --- sources
@query("""WITH g AS (SELECT 32 * count(*) AS n FROM part), q AS (SELECT count(*) AS n FROM orders), t AS (SELECT unnest(range(0, 4)) AS target)
SELECT CAST(target AS INTEGER) AS target, CAST(target * (g.n // 4) + least(target, g.n % 4) AS BIGINT) AS start,
CAST(g.n // 4 + CASE WHEN target < g.n % 4 THEN 1 ELSE 0 END AS BIGINT) AS portion, CAST(q.n // 4 + CASE WHEN target < q.n % 4 THEN 1 ELSE 0 END AS BIGINT) AS n_reads FROM t, g, q""")
def genome_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous parts of the genome and quotas of reads."""
    length = 32 * source.table(spark, sf_dir, "part").count()
    return source.partitions(spark, length, source.table(spark, sf_dir, "orders").count(), TARGETS)


READ_LENGTH = 100
SIMULATED = f"""genome AS (SELECT string_agg(translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY p_partkey) AS g FROM part),
starts AS (SELECT o_orderkey AS read_id, (o_orderkey * 7919) % (SELECT length(g) - {READ_LENGTH} + 1 FROM genome) AS start FROM orders)"""


def _simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = source.genome_chunks(spark, sf_dir)
    length = 32 * chunks.count()
    starts = source.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id"), ((F.col("o_orderkey") * 7919) % (length - READ_LENGTH + 1)).alias("start"))
    return source.cut_reads(chunks, starts, READ_LENGTH)


@query(f"WITH {SIMULATED} SELECT read_id, CAST(start AS BIGINT) AS start, substr(g, CAST(start + 1 AS BIGINT), {READ_LENGTH}) AS seq FROM starts, genome")
def simulated_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read per order from deterministic places of the genome."""
    return _simulated(spark, sf_dir)


@query(f"WITH {SIMULATED}, reads AS (SELECT read_id, substr(g, CAST(start + 1 AS BIGINT), {READ_LENGTH}) AS seq FROM starts, genome), {POSITIONS}, {OCC}, {RC}, {CANON} SELECT kmer, count(*) AS cnt, {_votes()} FROM canon GROUP BY kmer HAVING count(*) >= 2")
def simulated_kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical counts of the simulated reads."""
    return counting.counted(kmers.canonical_kmers(_simulated(spark, sf_dir), K)).where("cnt >= 2")


RANK_READS = f"""genome AS (SELECT string_agg(translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY p_partkey) AS g FROM part),
size AS (SELECT (SELECT length(g) FROM genome) AS len, (SELECT count(*) FROM orders) AS n),
parts AS (SELECT t AS target, t * (len // {TARGETS}) + least(t, len % {TARGETS}) AS first_, len // {TARGETS} + (t < len % {TARGETS})::BIGINT AS portion, t * (n // {TARGETS}) + least(t, n % {TARGETS}) AS id, n // {TARGETS} + (t < n % {TARGETS})::BIGINT AS quota FROM size, (SELECT unnest(range(0, {TARGETS})) AS t)),
numbered AS (SELECT *, id + unnest(range(0, quota)) AS read_id FROM parts),
starts AS (SELECT read_id, target, first_ + ('0x' || substr(md5(target || ':' || read_id), 1, 12))::BIGINT % (portion - {READ_LENGTH} + 1) AS start FROM numbered)"""


@query(f"WITH {RANK_READS} SELECT read_id, CAST(target AS INTEGER) AS target, CAST(start AS BIGINT) AS start, substr(g, CAST(start + 1 AS BIGINT), {READ_LENGTH}) AS seq FROM starts, genome")
def simulated_rank_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many reads as there are orders, each target's quota from within its own part of the genome."""
    chunks = source.genome_chunks(spark, sf_dir)
    starts = source.rank_starts(spark, 32 * chunks.count(), source.table(spark, sf_dir, "orders").count(), READ_LENGTH, TARGETS)
    cut = source.cut_reads(chunks, starts.select(F.struct("read_id", "target").alias("read_id"), "start"), READ_LENGTH)
    return cut.select("read_id.read_id", "read_id.target", "start", "seq")


# --- scalar functions
@query(f"WITH {READS}, {POSITIONS}, {OCC}, d AS (SELECT DISTINCT kmer FROM occ) SELECT kmer, list_reduce(list_transform(range(1, {K + 1}), lambda i: (instr('ACGT', substr(kmer, i, 1)) - 1)::BIGINT), lambda a, b: a * 4 + b) AS code FROM d")
def encode_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct k-mers as order-preserving longs."""
    return kmers.interior_kmers(source.text_reads(spark, sf_dir), K).select("kmer").distinct().select("kmer", sequence.pack(F.col("kmer")).alias("code"))


@query(f"WITH {READS}, {POSITIONS}, {OCC} SELECT count(DISTINCT kmer) AS kmers, count(DISTINCT kmer) AS equal, count(DISTINCT kmer) AS ordered FROM occ")
def unpack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed and unpacked again, k-mers are what they were, and their codes sort like them."""
    d = encode_pack(spark, sf_dir)
    back = d.withColumn("back", sequence.unpack(F.col("code"), K)).withColumn("limb", sequence.pack_limbs(F.col("kmer"))[0])
    return back.agg(F.count("*").alias("kmers"), F.count_if(F.col("back") == F.col("kmer")).alias("equal"), F.count_if(F.col("limb") == F.col("code")).alias("ordered"))


@query(f"WITH {READS}, k AS (SELECT read_id, unnest(list_transform(range(1, length(seq) - {K} + 2), lambda i: substr(seq, i, {K}))) AS kmer FROM reads WHERE length(seq) >= {K}) SELECT read_id, count(*) AS n, min(kmer) AS least, max(kmer) AS greatest FROM k GROUP BY read_id")
def all_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All k-mers of each read, first and last ones too."""
    r = source.text_reads(spark, sf_dir).where(F.length("seq") >= K)
    listed = r.select("read_id", sequence.kmers(F.col("seq"), K).alias("k"))
    return listed.select("read_id", F.size("k").cast("long").alias("n"), F.array_min("k").alias("least"), F.array_max("k").alias("greatest"))


@query(f"WITH {READS}, {POSITIONS}, {OCC}, {RC} SELECT DISTINCT kmer, rc FROM rcs")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.interior_kmers(source.text_reads(spark, sf_dir), K, with_rc=True).select("kmer", "rc").distinct()


@query("""WITH c AS (SELECT unnest(string_split(regexp_replace(text, '[^A-Z0-9]', '', 'g'), '')) AS base FROM documents), n AS (SELECT base, count(*) AS n FROM c WHERE base <> '' GROUP BY base)
SELECT base, CASE WHEN instr('ACGTN0URYKMSWBDHV', base) > 0 THEN translate(base, 'ACGTN0URYKMSWBDHV', 'TGCAN0NNNNNNNNNNN') ELSE '' END AS complement,
CAST(((ascii(base) & 4) >> 1) + (xor((ascii(base) & 4) >> 1, ascii(base) & 2) >> 1) AS INTEGER) AS code, n FROM n""")
def complement_iupac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capital or digit of the texts, its complement and its two bits."""
    docs = source.spread(source.table(spark, sf_dir, "documents").select("text"))
    each = docs.select(F.explode(F.split(F.regexp_replace("text", "[^A-Z0-9]", ""), "")).alias("base")).where("base <> ''").groupBy("base").agg(F.count("*").alias("n"))
    return each.select("base", sequence.complement_iupac(F.col("base")).alias("complement"), sequence.encode_base(F.col("base")).cast("int").alias("code"), "n")


@query(f"WITH {READS}, {POSITIONS}, {OCC}, {RC}, {CANON} SELECT l AS \"left\", r AS \"right\", count(*) AS n, count(DISTINCT kmer) AS kmers, min(kmer) AS least FROM canon GROUP BY l, r")
def canonical_ext_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions as the canonical strand sees them."""
    return kmers.canonical_kmers(source.text_reads(spark, sf_dir), K).groupBy("left", "right").agg(F.count("*").alias("n"), F.countDistinct("kmer").alias("kmers"), F.min("kmer").alias("least"))


@query(f"WITH {READS}, {POSITIONS}, {OCC}, d AS (SELECT kmer, count(*) AS n FROM occ GROUP BY kmer) SELECT {_minimizer('kmer')} AS minimizer, CAST(sum(n) AS BIGINT) AS n, count(*) AS kmers FROM d GROUP BY 1")
def minimizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strand-invariant minimizers, occurrences and distinct k-mers of each."""
    d = kmers.interior_kmers(source.text_reads(spark, sf_dir), K).groupBy("kmer").agg(F.count("*").alias("n"))
    return kmers.with_minimizer(d, K, M).groupBy("minimizer").agg(F.sum("n").alias("n"), F.count("*").alias("kmers"))


@query(f"WITH {READS}, {POSITIONS}, {OCC}, d AS (SELECT DISTINCT kmer FROM occ) SELECT list_max(list_transform(range(1, {K - M + 2}), lambda i: substr(kmer, i, {M}))) AS minimizer, count(*) AS kmers FROM d GROUP BY 1")
def minimizer_fwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimizers of the forward strand alone."""
    d = kmers.interior_kmers(source.text_reads(spark, sf_dir), K).select("kmer").distinct()
    return d.groupBy(sequence.minimizer_forward(F.col("kmer"), K, M).alias("minimizer")).agg(F.count("*").alias("kmers"))


@query(f"WITH hashing AS (SELECT o_orderkey AS key, o_orderkey AS x FROM orders), {_unsigned_quick('x')} SELECT key, CAST(v AS VARCHAR) AS hash FROM hashed")
def quick_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unsigned 64-bit mix of each order key, as text."""
    o = source.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("key"), hashes.quick_hash(F.col("o_orderkey").cast("long")).cast("string").alias("hash"))


@query(_targets() + " SELECT target, count(*) AS n, count(DISTINCT minimizer) AS minimizers FROM placed GROUP BY target")
def kmer_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition of each k-mer by the hash of its minimizer."""
    x = kmers.placed(source.text_reads(spark, sf_dir), K, TARGETS, M)
    return x.groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("minimizer").alias("minimizers"))


@query(_targets(m=15) + " SELECT minimizer, CAST((SELECT any_value(v) FROM hashed h WHERE h.minimizer = placed.minimizer) AS VARCHAR) AS hash, count(*) AS n FROM placed GROUP BY minimizer")
def minimizer_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash that partitions k-mers, of each 15-base minimizer."""
    x = kmers.with_minimizer(kmers.interior_kmers(source.text_reads(spark, sf_dir), K), K, 15).groupBy("minimizer").agg(F.count("*").alias("n"))
    return x.select("minimizer", hashes.minimizer_hash("minimizer").cast("string").alias("hash"), "n")


@query(f"WITH {READS}, {POSITIONS}, {OCC}, words AS (SELECT kmer, {_left_aligned('kmer', K)} AS x FROM (SELECT DISTINCT kmer FROM occ)), {_rows_with('words', _murmur3_steps('x', 'v'))} SELECT kmer, CAST(v AS VARCHAR) AS hash FROM hashed")
def kmer_slot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot hash of each distinct k-mer; tests hold it against published values too."""
    d = kmers.interior_kmers(source.text_reads(spark, sf_dir), K).select("kmer").distinct()
    return d.select("kmer", hashes.kmer_hash(1)("kmer").cast("string").alias("hash"))


@query(f"WITH orders_ AS (SELECT CAST(o_orderkey AS BIGINT) AS key FROM orders), {_rows_with('orders_', _murmur2_steps('key', 42, 'seeded') + _murmur3_steps('key', 'seedless'))} SELECT key, CAST(seeded AS VARCHAR) AS seeded, CAST(seedless AS VARCHAR) AS seedless FROM hashed")
def filter_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both filter hashes of each order key."""
    o = source.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("key"))
    return o.select("key", hashes.seeded_hash(42)("key").cast("string").alias("seeded"), hashes.key_hash("key").cast("string").alias("seedless"))


@query(f"""WITH {READS}, {POSITIONS}, {OCC}, p AS (SELECT l, r, count(*) AS n FROM occ GROUP BY l, r), c AS (SELECT l, r, n, greatest(instr('FACTG0', l) - 1, 0) * 8 + greatest(instr('FACTG0', r) - 1, 0) AS code FROM p)
SELECT CAST(code AS INTEGER) AS code, substr('FACTG0', CAST(code // 8 AS BIGINT) + 1, 1) AS "left", substr('FACTG0', CAST(code % 8 AS BIGINT) + 1, 1) AS "right", n FROM c""")
def pack_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of extensions in six bits, and back."""
    p = kmers.interior_kmers(source.text_reads(spark, sf_dir), K).groupBy("left", "right").agg(F.count("*").alias("n"))
    p = p.withColumn("code", sequence.pack_extensions(F.col("left"), F.col("right")))
    back = sequence.unpack_extensions(F.col("code"))
    return p.select(F.col("code").cast("int").alias("code"), back["left"].alias("left"), back["right"].alias("right"), "n")


@query(f"""WITH {DIRTY} SELECT read_id, translate(seq, '_0acgtACGTNn', '001234567899') || CASE WHEN length(seq) % 2 = 1 THEN '0' ELSE '' END AS packed, replace(seq, 'n', 'N') AS unpacked FROM reads""")
def pack4_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-bit packing of reads with quality and N, and back."""
    r = source.dirty_reads(spark, sf_dir).withColumn("packed", sequence.pack4(F.col("seq")))
    return r.select("read_id", "packed", sequence.unpack4(F.col("packed"), F.length("seq")).alias("unpacked"))


@query(f"""WITH {DIRTY} SELECT read_id, 3 + CAST(read_id % 2 AS INTEGER) AS start, replace(substr(seq, 4 + read_id % 2, 11), 'n', 'N') AS letters,
length(substr(seq, 4 + read_id % 2, 11)) + length(substr(seq, 4 + read_id % 2, 11)) % 2 AS half_bytes FROM reads WHERE length(seq) > 4""")
def pack4_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of packed reads from odd and even letters on."""
    r = source.dirty_reads(spark, sf_dir).where("length(seq) > 4").withColumn("start", (F.lit(3) + F.col("read_id") % 2).cast("int"))
    n = F.least(F.lit(11), F.length("seq") - F.col("start"))
    r = r.withColumn("part", sequence.slice4(sequence.pack4(F.col("seq")), F.col("start"), n))
    return r.select("read_id", "start", sequence.unpack4(F.col("part"), n).alias("letters"), F.length("part").cast("long").alias("half_bytes"))


@query("""WITH c AS (SELECT unnest(string_split(regexp_replace(text, '[^A-Za-z0-9_]', '', 'g'), '')) AS base FROM documents), n AS (SELECT base, count(*) AS n FROM c WHERE base <> '' GROUP BY base)
SELECT base, n, base SIMILAR TO '[acgtn]' AS low, base SIMILAR TO '[ACGT0N]' AS inserted, base NOT IN ('_', 'N') AS in_supermer FROM n""")
def base_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three predicates on letters beside a k-mer, for every letter of the texts."""
    docs = source.spread(source.table(spark, sf_dir, "documents").select("text"))
    each = docs.select(F.explode(F.split(F.regexp_replace("text", "[^A-Za-z0-9_]", ""), "")).alias("base")).where("base <> ''").groupBy("base").agg(F.count("*").alias("n"))
    base = F.col("base")
    return each.select("base", "n", sequence.low_quality(base).alias("low"), sequence.valid_inserted(base).alias("inserted"), sequence.valid_in_supermer(base).alias("in_supermer"))


# --- k-mers of reads with N and quality
@query(f"WITH {DIRTY}, {POSITIONS}, {RAW} SELECT read_id, count(*) AS windows, CAST(count(*) FILTER (regexp_full_match(kmer, '[ACGTacgt]+')) AS BIGINT) AS valid, CAST(count(*) FILTER (l SIMILAR TO '[acgtn]') AS BIGINT) AS low_left FROM raw GROUP BY read_id")
def valid_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows without N, per read, and low-quality neighbours."""
    x = kmers.interior_kmers(source.dirty_reads(spark, sf_dir), K)
    return x.groupBy("read_id").agg(F.count("*").alias("windows"), F.count_if(sequence.is_clean(F.col("kmer"))).alias("valid"), F.count_if(sequence.low_quality(F.col("left"))).alias("low_left"))


@query(f"WITH {DIRTY}, {POSITIONS}, {RAW}, {MASKED}, {RC}, {CANON.replace(chr(39) + 'ACGT' + chr(39), chr(39) + 'ACGT' + chr(39))} SELECT kmer, count(*) AS cnt, {_votes()} FROM canon GROUP BY kmer HAVING count(*) >= 2")
def quality_masked_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts where low-quality neighbours have no vote."""
    return counting.counted(kmers.masked_kmers(source.dirty_reads(spark, sf_dir), K)).where("cnt >= 2")


@query(f"WITH {READS}, {POSITIONS}, {OCC} SELECT l AS \"left\", r AS \"right\", count(*) AS n, count(DISTINCT read_id) AS reads FROM occ GROUP BY l, r")
def interior_kmers_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = kmers.interior_kmers(source.text_reads(spark, sf_dir), K)
    return x.groupBy("left", "right").agg(F.count("*").alias("n"), F.countDistinct("read_id").alias("reads"))


@query(f"WITH {READS} SELECT count(*) AS reads, CAST(sum(greatest(0, length(seq) - {K + 1})) AS BIGINT) AS expected, CAST(sum(greatest(0, length(seq) - {K + 1})) AS BIGINT) AS counted FROM reads")
def read_len_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No occurrence is lost: the counts add up to what read lengths allow."""
    r = source.text_reads(spark, sf_dir)
    counted = counting.counted(kmers.canonical_kmers(r, K)).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n")).first().n
    return r.agg(F.count("*").alias("reads"), F.sum(F.greatest(F.lit(0), F.length("seq") - (K + 1))).alias("expected"), F.lit(counted).cast("long").alias("counted"))


# --- supermers
@query(_targets() + ISLANDS + " SELECT read_id, target, CAST(off AS INTEGER) AS \"offset\", seq FROM supers")
def supermers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.supermers(source.text_reads(spark, sf_dir), K, TARGETS, M)


@query(_targets(DIRTY, RAW + ", occ AS (SELECT read_id, pos, upper(kmer) AS kmer FROM raw WHERE regexp_full_match(kmer, '[ACGTacgt]+') AND l <> 'N' AND r <> 'N')") + ISLANDS + " SELECT read_id, target, CAST(off AS INTEGER) AS \"offset\", seq FROM supers")
def supermers_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supermers that end at N."""
    return kmers.supermers(source.dirty_reads(spark, sf_dir), K, TARGETS, M, clean_only=True)


@query(_targets() + ISLANDS + f" SELECT target, count(*) AS supermers, CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(sum(length(seq) - {K + 1}) AS BIGINT) AS kmers FROM supers GROUP BY target")
def supermer_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each target receives."""
    s = kmers.supermers(source.text_reads(spark, sf_dir), K, TARGETS, M)
    return s.groupBy("target").agg(F.count("*").alias("supermers"), F.sum(F.length("seq")).alias("bases"), F.sum(F.length("seq") - (K + 1)).alias("kmers"))


@query(f"{FORWARD} SELECT * FROM counts WHERE cnt >= 2")
def supermer_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by the supermer route: routed to targets, taken apart and counted there; only split targets are shuffled again."""
    targets = max(TARGETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    s = kmers.supermers(source.text_reads(spark, sf_dir), K, targets, M)
    loads = s.groupBy("target").agg(F.sum(F.length("seq") - (K + 1)).alias("load"))
    parts = counting.counted(kmers.expanded(kmers.routed(s, loads).drop("read_id", "offset"), K), "target", "salt", "split")
    return counting.added(parts).where("cnt >= 2")


# --- counting
@query(f"{FORWARD} SELECT * FROM counts WHERE cnt >= 2")
def kmer_counts_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.counted(kmers.interior_kmers(source.text_reads(spark, sf_dir), K)).where("cnt >= 2")


@query(f"{FORWARD} SELECT kmer, cnt AS count, list_max([{{'n': l_a, 'b': 'A'}}, {{'n': l_c, 'b': 'C'}}, {{'n': l_g, 'b': 'G'}}, {{'n': l_t, 'b': 'T'}}]).b AS \"left\", list_max([{{'n': r_a, 'b': 'A'}}, {{'n': r_c, 'b': 'C'}}, {{'n': r_g, 'b': 'G'}}, {{'n': r_t, 'b': 'T'}}]).b AS \"right\" FROM counts")
def ext_vote_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-mer of the forward strand with its plain majority neighbours."""
    return counting.called(counting.counted(kmers.interior_kmers(source.text_reads(spark, sf_dir), K)), depth=None)


@query(f"{COUNTS}, {CALLS} SELECT * FROM calls")
def ext_vote_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with dead ends and forks."""
    return counting.called(counting.purged(counting.counted(kmers.canonical_kmers(source.text_reads(spark, sf_dir), K))))


@query(f"{COUNTS} SELECT * FROM counts WHERE cnt >= 2 AND {ANY_VOTE}")
def kmer_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.purged(counting.counted(kmers.canonical_kmers(source.text_reads(spark, sf_dir), K)))


@query(f"{COUNTS} SELECT kmer, cnt, " + ", ".join(f"least({v}, 2) AS {v}" for v in counting.VOTES) + " FROM counts WHERE cnt >= 2")
def ext_saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes that saturate, here at a cap of 3."""
    return counting.saturated(counting.counted(kmers.canonical_kmers(source.text_reads(spark, sf_dir), K)), cap=3).where("cnt >= 2")


@query(f"{COUNTS}, {CALLS} SELECT kmer, least(count, 65535) AS count, \"left\", \"right\" FROM calls WHERE \"left\" NOT IN ('X', 'F') AND \"right\" NOT IN ('X', 'F')")
def kmer_uu_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: canonical k-mers seen twice or more with one clear neighbour on either side."""
    counts = counting.counted(kmers.canonical_kmers(source.text_reads(spark, sf_dir), K))  # calls are made on whole votes: capped ones fall short of a share of a count that goes on
    return counting.unique_both_ways(counting.called(counting.purged(counts)))


@query(f"WITH {DIRTY}, {POSITIONS}, {RAW}, {MASKED}, {RC}, {CANON}, counts AS (SELECT kmer, count(*) AS cnt, {_votes()} FROM canon GROUP BY kmer), {CALLS} SELECT kmer, least(count, 65535) AS count, \"left\", \"right\" FROM calls WHERE \"left\" NOT IN ('X', 'F') AND \"right\" NOT IN ('X', 'F')")
def kmer_uu_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of reads with N and quality."""
    counts = counting.counted(kmers.masked_kmers(source.dirty_reads(spark, sf_dir), K))
    return counting.unique_both_ways(counting.called(counting.purged(counts)))


@query(f"WITH reads AS (SELECT doc_id AS read_id, translate(upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')), 'N', 'G') AS seq FROM documents), {POSITIONS}, {OCC}, counts AS (SELECT kmer, count(*) AS cnt, {_votes()} FROM occ GROUP BY kmer) SELECT * FROM counts WHERE cnt >= 2")
def kmer_counts_n_as_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward counts of reads whose N are taken for G."""
    return counting.counted(kmers.interior_kmers(kmers.n_as_g(source.dirty_reads(spark, sf_dir)), K)).where("cnt >= 2")


# --- reports
PLACED_COUNTS = _targets() + ", counts AS (SELECT target, kmer, count(*) AS cnt FROM placed GROUP BY target, kmer)"


def _placed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = kmers.interior_kmers(source.text_reads(spark, sf_dir), K).groupBy("kmer").agg(F.count("*").alias("cnt"))
    return kmers.with_target(x, K, TARGETS, M)


@query(PLACED_COUNTS + " SELECT target, count(*) AS kmers, CAST(sum(cnt) AS BIGINT) AS total FROM counts GROUP BY target")
def rank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed_counts(spark, sf_dir).groupBy("target").agg(F.count("*").alias("kmers"), F.sum("cnt").alias("total"))


@query(PLACED_COUNTS + ISLANDS + ", c AS (SELECT target, count(*) AS kmers, CAST(sum(cnt) AS BIGINT) AS total FROM counts GROUP BY target), s AS (SELECT target, count(*) AS supermers FROM supers GROUP BY target) SELECT * FROM c JOIN s USING (target)")
def rank_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's k-mers, their total count and the supermers inserted there."""
    runs = kmers.supermers(source.text_reads(spark, sf_dir), K, TARGETS, M)
    return counting.target_report(_placed_counts(spark, sf_dir), runs)


@query(PLACED_COUNTS + ", m AS (SELECT target, max(cnt) AS most FROM counts GROUP BY target) SELECT avg(most) AS threshold FROM m")
def high_count_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over targets of the largest count."""
    return _placed_counts(spark, sf_dir).groupBy("target").agg(F.max("cnt").alias("most")).agg(F.avg("most").alias("threshold"))


@query(PLACED_COUNTS + ", m AS (SELECT target, count(*) AS n FROM counts GROUP BY target) SELECT min(n) AS least, CAST(sum(n) AS BIGINT) AS total, max(n) AS most, avg(n) AS mean FROM m")
def reduce_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, total, most and mean load of the targets."""
    loads = _placed_counts(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n"))
    return loads.agg(F.min("n").alias("least"), F.sum("n").alias("total"), F.max("n").alias("most"), F.avg("n").alias("mean"))


@query(
    f"{COUNTS}, a AS (SELECT CAST(sum(greatest(0, length(seq) - {K + 1})) AS BIGINT) AS attempted FROM reads), "
    "t AS (SELECT CAST(sum(cnt) AS BIGINT) AS taken, count(*) AS seen, CAST(count(*) FILTER (cnt = 1) AS BIGINT) AS singletons, CAST(count(*) FILTER (cnt >= 2) AS BIGINT) AS new_inserts FROM counts) "
    "SELECT attempted, attempted - taken AS dropped, seen AS num_unique_qf, singletons, new_inserts, seen - singletons - new_inserts AS dropped_qf FROM a, t"
)
def insert_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a k-mer table behind a filter of first sightings was asked to take.

    Attempts come from the lengths of reads, the rest from the counts: what neither the filter holds (seen once) nor the
    table (seen again) was dropped.
    """
    r = source.text_reads(spark, sf_dir)
    attempted = r.agg(F.sum(F.greatest(F.lit(0), F.length("seq") - (K + 1))).cast("long").alias("attempted"))
    c = kmers.canonical_kmers(r, K).groupBy("kmer").agg(F.count("*").alias("cnt"))
    t = c.agg(F.sum("cnt").alias("taken"), F.count("*").alias("num_unique_qf"), F.count_if(F.col("cnt") == 1).alias("singletons"), F.count_if(F.col("cnt") >= 2).alias("new_inserts"))
    both = attempted.select("attempted", F.lit(1).alias("one")).join(t.withColumn("one", F.lit(1)), "one")  # one row each
    return both.select(
        "attempted", (F.col("attempted") - F.col("taken")).alias("dropped"), "num_unique_qf", "singletons", "new_inserts",
        (F.col("num_unique_qf") - F.col("singletons") - F.col("new_inserts")).alias("dropped_qf"),
    )


# --- contigs
CONTIGS = (
    "creads AS (SELECT item_id AS read_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS seq, 1 + item_id % 7 AS depth FROM benchmark), "
    f"cat AS (SELECT read_id, seq, depth, unnest(range(1, length(seq) - {K})) AS pos FROM creads WHERE length(seq) >= {K + 2}), "
    f"cocc AS (SELECT depth, substr(seq, pos + 1, {K}) AS kmer, substr(seq, pos, 1) AS l, substr(seq, pos + {K + 1}, 1) AS r FROM cat), "
    "crcs AS (SELECT *, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc FROM cocc), "
    + CANON.replace("canon AS (SELECT read_id, pos,", "ccanon AS (SELECT depth,").replace("FROM rcs", "FROM crcs")
    + f", ccounts AS (SELECT kmer, min(depth) AS cnt, {_votes('depth')} FROM ccanon GROUP BY kmer)"
)


def _contig_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = source.contigs(spark, sf_dir).withColumnRenamed("contig_id", "read_id")
    return counting.from_contigs(kmers.canonical_kmers(c, K).join(c.select("read_id", "depth"), "read_id"))


@query(f"WITH {CONTIGS} SELECT * FROM ccounts")
def contig_min_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contig_counts(spark, sf_dir)


_C = [f"c.{v}" for v in counting.VOTES]
_SIDES = " AND ".join("(" + " + ".join(f"(c.{s}_{b} > 0)::INTEGER" for b in "acgt") + ") <= 1" for s in "lr")
_TAKE = "(r.cnt IS NULL OR (c.cnt IS NOT NULL AND r.unclear))"


@query(
    f"{COUNTS}, {CONTIGS}, r AS (SELECT *, {_depth_call('l')} IN ('X', 'F') OR {_depth_call('r')} IN ('X', 'F') AS unclear FROM counts WHERE cnt >= 2), c AS (SELECT * FROM ccounts c WHERE {_SIDES}) "
    f"SELECT coalesce(r.kmer, c.kmer) AS kmer, {', '.join(f'CASE WHEN {_TAKE} THEN c.{v} ELSE r.{v} END AS {v}' for v in ['cnt', *counting.VOTES])}, "
    f"CASE WHEN r.cnt IS NULL THEN 'added' WHEN {_TAKE} THEN 'replaced' ELSE 'kept' END AS origin FROM r FULL JOIN c ON r.kmer = c.kmer"
)
def contig_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read counts with contig k-mers merged in."""
    reads = counting.purged(counting.counted(kmers.canonical_kmers(source.text_reads(spark, sf_dir), K)))
    return counting.merged(reads, _contig_counts(spark, sf_dir))
