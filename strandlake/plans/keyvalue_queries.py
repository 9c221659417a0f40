"""Queries on keyed tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import slots
from ..operators import filters
from ..operators import keyvalue as kv
from ..sources import keys
from ..sources.reads import table
from .registry import query


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("key"), F.col("o_custkey").cast("long").alias("val"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all line items, and the same keys moved so that some are missing."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("key"), F.col("l_linenumber").cast("int").alias("n"))
    return x.select("key").unionByName(x.select((F.col("key") * 3 + F.col("n")).alias("key")))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("key"), F.col("event_type").alias("val"), F.col("event_id").cast("long").alias("seq"))


PAIRS = "pairs AS (SELECT CAST(o_orderkey AS BIGINT) AS key, CAST(o_custkey AS BIGINT) AS val FROM orders)"
PROBES = "probes AS (SELECT CAST(l_orderkey AS BIGINT) AS key FROM lineitem UNION ALL SELECT CAST(l_orderkey * 3 + l_linenumber AS BIGINT) FROM lineitem)"
EVENTS = "ev AS (SELECT CAST(user_id AS BIGINT) AS key, event_type AS val, CAST(event_id AS BIGINT) AS seq FROM events)"


@query(f"WITH {PAIRS} SELECT key, val FROM pairs UNION ALL SELECT CAST(l_orderkey AS BIGINT), CAST(l_partkey AS BIGINT) FROM lineitem")
def kv_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("key"), F.col("l_partkey").cast("long").alias("val"))
    return kv.append(_pairs(spark, sf_dir), more)


@query(f"WITH {PAIRS} SELECT key, val FROM pairs UNION ALL SELECT CAST(l_orderkey AS BIGINT), 0 FROM lineitem")
def kv_insert_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.append(_pairs(spark, sf_dir), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("key")))


@query(f"WITH {PAIRS}, more AS (SELECT CAST(l_orderkey * 3 + l_linenumber AS BIGINT) AS key, CAST(l_partkey AS BIGINT) AS val, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS seq FROM lineitem) SELECT key, val FROM pairs UNION ALL SELECT key, min({{'seq': seq, 'val': val}}).val FROM more WHERE key NOT IN (SELECT key FROM pairs) GROUP BY key")
def kv_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    more = li.select((F.col("l_orderkey") * 3 + F.col("l_linenumber")).cast("long").alias("key"), F.col("l_partkey").cast("long").alias("val"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("seq"))
    return kv.insert_if_absent(_pairs(spark, sf_dir), more)


@query(f"""WITH {PAIRS}, more AS (SELECT CAST(user_id * 97 + event_id % 5 AS BIGINT) AS key, CAST(event_id * 3 AS BIGINT) AS val, CAST(event_id AS BIGINT) AS seq FROM events),
r AS (SELECT *, row_number() OVER w AS n, first_value(val) OVER w AS first_val FROM more WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT r.key, r.seq, p.val IS NOT NULL OR r.n > 1 AS found, CASE WHEN p.val IS NOT NULL THEN p.val WHEN r.n > 1 THEN r.first_val END AS existing FROM r LEFT JOIN pairs p ON p.key = r.key""")
def kv_insert_or_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts that find a key return its value."""
    e = table(spark, sf_dir, "events")
    more = e.select((F.col("user_id") * 97 + F.col("event_id") % 5).cast("long").alias("key"), (F.col("event_id") * 3).cast("long").alias("val"), F.col("event_id").cast("long").alias("seq"))
    return kv.insert_or_get(_pairs(spark, sf_dir), more)


@query(f"WITH {EVENTS} SELECT key, max({{'seq': seq, 'val': val}}).val AS val FROM ev GROUP BY key HAVING count(*) % 2 = 1")
def kv_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.toggled(_events(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT key, val, seq, row_number() OVER (PARTITION BY key ORDER BY seq) % 2 = 0 AS found FROM ev")
def kv_toggle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.toggle_log(_events(spark, sf_dir))


@query(f"WITH {PAIRS}, {PROBES} SELECT p.key, q.val, q.val IS NOT NULL AS found FROM probes p LEFT JOIN pairs q ON p.key = q.key")
def kv_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.lookup(_pairs(spark, sf_dir), _probes(spark, sf_dir))


@query(f"WITH {PAIRS}, {PROBES} SELECT key FROM probes WHERE key IN (SELECT key FROM pairs)")
def kv_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.present(_pairs(spark, sf_dir), _probes(spark, sf_dir))


@query(f"WITH {EVENTS}, pairs AS (SELECT key, seq AS val FROM ev), gone AS (SELECT key, count(*) AS times FROM ev WHERE val = (SELECT min(val) FROM ev) GROUP BY key), ranked AS (SELECT key, val, row_number() OVER (PARTITION BY key ORDER BY val) AS n FROM pairs) SELECT r.key, r.val FROM ranked r LEFT JOIN gone g ON r.key = g.key WHERE r.n > coalesce(g.times, 0)")
def kv_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event of the first type removes one pair of its user."""
    e = _events(spark, sf_dir)
    first = e.agg(F.min("val").alias("val"))
    return kv.remove_one(e.select("key", F.col("seq").alias("val")), e.join(F.broadcast(first), "val", "left_semi").select("key"))


@query(f"WITH {EVENTS} SELECT count(*) AS live, count(DISTINCT key) AS keys, CAST(1048576 AS BIGINT) AS slots, count(*) / 1048576 AS load FROM ev")
def kv_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.fill(_events(spark, sf_dir), 1 << 20)


@query(f"WITH {EVENTS} SELECT key, min({{'seq': seq, 'val': val}}).val AS val FROM ev GROUP BY key")
def kv_insert_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.first_wins(_events(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT key, max({{'seq': seq, 'val': val}}).val AS val FROM ev GROUP BY key")
def kv_upsert_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.last_wins(_events(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT key, least(count(*), 5) AS cnt FROM ev GROUP BY key")
def kv_count_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.counted_keys(_events(spark, sf_dir), 5)


@query(f"WITH {EVENTS} SELECT DISTINCT key FROM ev")
def kv_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.distinct_keys(_events(spark, sf_dir))


@query(f"WITH {PAIRS}, {PROBES} SELECT (SELECT count(*) FROM probes) AS probes, (SELECT count(*) FROM probes WHERE key NOT IN (SELECT key FROM pairs)) AS misses")
def bulk_query_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = kv.lookup(_pairs(spark, sf_dir), _probes(spark, sf_dir))
    return got.agg(F.count("*").alias("probes"), F.count_if(~F.col("found")).alias("misses"))


@query(f"WITH {PAIRS}, p AS (SELECT *, key % 20 AS batch FROM pairs), o AS (SELECT key * 3 + 1 AS key, key % 20 AS batch FROM pairs), stored AS (SELECT key, min(val) AS val FROM pairs GROUP BY key), own AS (SELECT batch, count(*) AS inserted, count(s.key) AS found, count(*) FILTER (s.val = p.val) AS right_value FROM p LEFT JOIN stored s ON s.key = p.key GROUP BY batch), other AS (SELECT o.batch, count(*) AS probed, count(q.key) AS hits FROM o LEFT JOIN pairs q ON o.key = q.key GROUP BY o.batch) SELECT own.*, other.probed, other.hits FROM own JOIN other USING (batch)")
def filter_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, look up, check values, and look up other keys, in 20 batches."""
    p = _pairs(spark, sf_dir).withColumn("batch", F.col("key") % 20)
    return kv.batch_report(p, p.select((F.col("key") * 3 + 1).alias("key"), "batch"), 20)


def _step(columns: str, held: str, asked: str) -> str:
    """SQL of one row: fill of the table ``held`` and how many of the keys ``asked`` it doesn't have."""
    return f"SELECT {columns}, (SELECT count(*) FROM {asked} a ANTI JOIN {held} h ON a.key = h.key) AS misses FROM {held}"


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (ORDER BY key) AS pos, count(*) OVER () AS n FROM pairs),
half AS (SELECT key, val FROM r WHERE pos <= n // 2), rest AS (SELECT key, val FROM r WHERE pos > n // 2), deleted AS (SELECT * FROM pairs EXCEPT ALL SELECT * FROM half), again AS (SELECT * FROM deleted UNION ALL SELECT * FROM half)
{_step("'before' AS step, count(*) AS fill", "pairs", "pairs")} UNION ALL {_step("'deleted', count(*)", "deleted", "rest")} UNION ALL {_step("'added', count(*)", "again", "pairs")}""")
def filter_delete_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all, delete the first half by key, look up the rest, add the half again."""
    pairs = _pairs(spark, sf_dir)
    middle = _median_key(pairs)
    half, rest = pairs.where(F.col("key") <= middle), pairs.where(F.col("key") > middle)
    left = kv.remove_one(pairs, half.select("key"))
    again = kv.append(left, half)
    spark_row = lambda name, held, asked: kv.missing(held, asked.select("key")).agg(F.count("*").alias("misses")).join(held.agg(F.count("*").alias("fill"))).select(F.lit(name).alias("step"), "fill", "misses")
    return spark_row("before", pairs, pairs).unionByName(spark_row("deleted", left, rest)).unionByName(spark_row("added", again, pairs))


def _median_key(pairs: DataFrame, cells: int = 1024) -> int:
    """The greatest key of the first half of the rows, by counts of ever narrower cells: at most so many counts a round leave the executors."""
    low, high, n = pairs.agg(F.min("key"), F.max("key"), F.count("*")).first()
    want = n // 2
    if want == 0:
        return -1 if low is None else low - 1
    while low < high:
        width = (high - low) // cells + 1
        counts = pairs.where(F.col("key").between(low, high)).groupBy(F.expr(f"(key - ({low})) div {width}").alias("cell")).agg(F.count("*").alias("n")).collect()
        for cell, here in sorted(counts):
            if want <= here:
                break
            want -= here
        low = low + cell * width
        high = min(high, low + width - 1)
    return low


def _sawtooth_sql(rounds: int) -> str:
    """Every round's table by multiset difference and union of the one before."""
    tables = ["p AS (SELECT key, val, key % 8 AS part, -1 - key AS fresh FROM pairs)", "t0 AS (SELECT key, val FROM pairs)"]
    for i in range(rounds):
        tables.append(f"t{i + 1} AS ((SELECT * FROM t{i} EXCEPT ALL SELECT key, val FROM p WHERE part = {i}) UNION ALL SELECT fresh, val FROM p WHERE part = {i})")
        tables.append(f"asked{i} AS (SELECT CASE WHEN part > {i} THEN key ELSE fresh END AS key FROM p)")
    parts = [_step(f"CAST({i} AS BIGINT) AS round, count(*) FILTER (key >= 0) AS old_left, count(*) FILTER (key < 0) AS added", f"t{i + 1}", f"asked{i}") for i in range(rounds)]
    return f"WITH {PAIRS}, {', '.join(tables)} {' UNION ALL '.join(parts)}"


@query(_sawtooth_sql(6))
def filter_sawtooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each round deletes one part and adds a new one; what should be there is looked up."""
    pairs = _pairs(spark, sf_dir)
    part, new = F.col("key") % 8, F.bitwise_not("key").alias("key")
    held, out = pairs, None
    for i in range(6):
        gone = pairs.where(part == i)
        held = kv.append(kv.remove_one(held, gone.select("key")), gone.select(new, "val"))
        # after a round the table holds the old parts above it and the new parts up to it
        asked = pairs.where(part > i).select("key").unionByName(pairs.where(part <= i).select(new))
        filled = held.groupBy(F.lit(i).cast("long").alias("round")).agg(F.count_if(F.col("key") >= 0).alias("old_left"), F.count_if(F.col("key") < 0).alias("added"))
        row = filled.join(kv.missing(held, asked).agg(F.count("*").alias("misses")))
        out = row if out is None else out.unionByName(row)
    return out


HASH = "('0x' || substr(md5(CAST(key AS VARCHAR)), 1, 8))::BIGINT"


@query(f"WITH {PAIRS}, h AS (SELECT {HASH} AS h FROM pairs), t AS (SELECT (h >> 10) % 64 AS bucket, CASE WHEN h & 1023 = 0 THEN 1 WHEN h & 1023 = 1023 THEN 1022 ELSE h & 1023 END AS tag FROM h), g AS (SELECT bucket, tag, count(*) AS n FROM t GROUP BY bucket, tag) SELECT CAST(sum(n) AS BIGINT) AS keys, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS colliding, max(n) AS largest FROM g")
def tag_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a filter of 64 buckets and 10-bit tags can't tell apart."""
    h = F.conv(F.substring(F.md5(F.col("key").cast("string")), 1, 8), 16, 10).cast("long")
    return kv.tag_collisions(_pairs(spark, sf_dir), h, 10, 64)


@query()
def first_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where filters of fixed size refuse their first key."""
    p = _pairs(spark, sf_dir).select("key", F.col("key").alias("seq"))
    return kv.bounded_filter(p, buckets=64, bucket_size=8, tag_bits=10, shards=8)


def _replay_size(events: DataFrame, load: float = 0.5, shard_keys: int = 1 << 16) -> tuple[int, int]:
    """(shards, buckets of 16 slots in each) for the keys of the events: both follow the input."""
    keys_ = events.select("key").distinct().count()
    shards = max(8, -(-keys_ // shard_keys))
    return shards, max(64, int(keys_ / shards / load / 16) + 1)


@query(f"""WITH {EVENTS}, n AS (SELECT key, seq, row_number() OVER w AS n, lag(seq) OVER w AS before FROM ev WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT key, seq, true AS done, n % 2 = 0 AS found, CASE WHEN n % 2 = 0 THEN before END AS got FROM n""")
def filter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toggles of users in tables of bounded size that keep whole keys: nothing is refused, lost or taken for another."""
    e = _events(spark, sf_dir).select("key", "seq", F.lit("toggle").alias("op"), F.col("seq").alias("val"))
    shards, buckets = _replay_size(e)
    return filters.replayed(e, filters.Shape(buckets, choose="first", tag_bits=0), shards).drop("op")


@query()
def filter_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all orders, remove the odd ones, look all up: outcomes of each way to choose a bucket, at a load of nine tenths."""
    p = _pairs(spark, sf_dir).withColumn("odd", F.col("key") % 2 == 1)
    step = lambda n, op, rows: rows.select("key", (F.col("key") * 4 + (n << 58)).alias("seq"), F.lit(op).alias("op"), F.col("val").bitwiseAND(63).alias("val"))
    events = step(0, "insert", p).unionByName(step(1, "remove", p.where("odd"))).unionByName(step(2, "query", p))
    shards, buckets = _replay_size(p, 0.9)
    out = None
    for choose in ("shortcut", "least", "first"):
        for backing in (0, max(1, buckets // 9)):
            shape = filters.Shape(buckets, choose=choose, backing=backing)
            rows = filters.outcomes(filters.replayed(events, shape, shards)).select(F.lit(choose).alias("choose"), F.lit(backing > 0).alias("backed"), "op", "events", "done", "found")
            out = rows if out is None else out.unionByName(rows)
    return out


DHT = "d AS (SELECT CAST(c_custkey % 8 AS INTEGER) AS rank, CAST(c_custkey // 8 AS BIGINT) AS i, CAST(c_custkey % 8 AS VARCHAR) || ':' || CAST(c_custkey // 8 AS VARCHAR) AS key FROM customer)"


def _dht(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    rank, i = (c % 8).cast("int"), F.floor(c / 8).cast("long")
    return table(spark, sf_dir, "customer").select(rank.alias("rank"), i.alias("i"), F.concat_ws(":", rank, i).alias("key"))


@query(f"WITH {DHT} SELECT ('0x' || substr(md5(key), 1, 8))::BIGINT % 8 AS owner, count(*) AS keys FROM d GROUP BY 1")
def dht_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dht(spark, sf_dir).groupBy(kv.owner(F.col("key"), 8).alias("owner")).agg(F.count("*").alias("keys"))


@query(f"WITH {EVENTS} SELECT CAST(key AS VARCHAR) AS key, min({{'seq': seq, 'val': val}}).val AS val FROM ev GROUP BY key")
def dht_insert_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return kv.first_wins(e.withColumn("key", F.col("key").cast("string")))


@query(f"WITH {DHT} SELECT q.key, coalesce(d.key, '') AS val FROM (SELECT CAST(c_custkey % 9 AS VARCHAR) || ':' || CAST(c_custkey // 9 AS VARCHAR) AS key FROM customer) q LEFT JOIN d ON q.key = d.key")
def dht_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of keys, empty where there is none."""
    d = _dht(spark, sf_dir).select("key", F.col("key").alias("val"))
    c = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(F.concat_ws(":", (c % 9).cast("int"), F.floor(c / 9).cast("long")).alias("key"))
    return kv.lookup(d, asked, F.lit("")).select("key", "val")


@query(f"WITH {DHT} SELECT CAST((rank + 7) % 8 AS INTEGER) AS rank, count(*) AS asked, count(*) AS agreeing FROM d GROUP BY 1")
def dht_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rank looks up the keys of the next one."""
    return kv.neighbours_agree(_dht(spark, sf_dir).withColumn("val", F.col("key")), 8)


def _digest(x: str, seed: str, digits: int = 15) -> str:
    return f"('0x' || substr(md5('{seed}:' || CAST({x} AS VARCHAR)), 1, {digits}))::BIGINT"


@query(f"SELECT o_orderkey AS pos, {_digest('o_orderkey', 'pairs')} AS key, {_digest('o_orderkey', 'pairsv', 8)} & 63 AS val FROM orders")
def random_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pseudo-random key and value for each order."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(o.alias("pos"), keys.digest_number(o, "pairs").alias("key"), keys.digest_number(o, "pairsv", 8).bitwiseAND(63).alias("val"))


@query(f"""WITH k AS (SELECT o_orderkey AS key, {_digest('o_orderkey', 'h', 12)} AS h, {_digest('o_orderkey', 's', 6)} AS s FROM orders)
SELECT key, h % 1021 AS linear_0, (h + 3) % 1021 AS linear_3, ((h % 1021) + 3 * (s % 1021)) % 1021 AS double_3, (h >> 10) % 1021 AS bucket, xor(h >> 10, (h & 1023) * 1540483477) % 1021 AS other FROM k""")
def probe_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets that tables of 1021 buckets try for each order key."""
    o = F.col("o_orderkey")
    k = table(spark, sf_dir, "orders").select(o.alias("key"), keys.digest_number(o, "h", 12).alias("h"), keys.digest_number(o, "s", 6).alias("s"))
    k = k.withColumns({"l": slots.linear_probes(F.col("h"), 4, 1021), "d": slots.double_probes(F.col("h"), F.col("s"), 4, 1021), "x": slots.xor_choices(F.col("h"), 10, 1021)})
    return k.select("key", F.col("l")[0].alias("linear_0"), F.col("l")[3].alias("linear_3"), F.col("d")[3].alias("double_3"), F.col("x")[0].alias("bucket"), F.col("x")[1].alias("other"))


@query(f"""WITH k AS (SELECT o_orderkey AS key, {_digest('o_orderkey', 'h', 12)} & 1023 AS low, o_custkey & 63 AS val FROM orders), t AS (SELECT key, val, CASE WHEN low = 0 THEN 1 WHEN low = 1023 THEN 1022 ELSE low END AS tag FROM k)
SELECT key, tag * 64 + val AS slot, tag, CAST(val AS BIGINT) AS val FROM t""")
def packed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-bit tags and six-bit values in one number, and back."""
    o = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(o.alias("key"), slots.pack_slot(kv.tag(keys.digest_number(o, "h", 12), 10), F.col("o_custkey"), 6).alias("slot"))
    return t.select("key", "slot", slots.slot_tag(F.col("slot"), 6).alias("tag"), slots.slot_value(F.col("slot"), 6).alias("val"))
