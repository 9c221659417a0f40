"""Personal data: fixed patterns, and information-theoretic sanitisation, with DataFrame functions only.

The patterns find protected entities of four kinds. Over the whole corpus, words near entities of a kind are
counted against the same words anywhere. Pointwise mutual information says how much a word reveals that an
entity of the kind is near; divided by the kind's own information content it is 1 for a word that occurs nowhere
else. Words that reach the threshold are spans of kind term wherever they stand, in texts without entities too:
sanitising generalises them, or removes the plainest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The patterns of the contract, written so that Java's engine neither backtracks nor recurses.
# (?:\G|(?<!...)) holds a match to the start of a run, or to the end of the match before.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"  # runs of fewer than 14 digits fail anyhow
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{3,}+"
KINDS = ["email", "ip", "card", "phone"]

#: Characters on either side of an entity whose words may reveal it.
REACH = 60
#: Occurrences near a kind below which a word's share says too little.
SUPPORT = 30
#: Share of the kind's information from which a word is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.9, 0.99
#: Slots of the table of revealing words that goes to the texts.
SLOTS = 4096


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        x = digits.substr(i, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _small_parts(s: Column) -> Column:
    value = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(s, r"\."), lambda p: (F.length(value(p)) < 3) | ((F.length(value(p)) == 3) & (value(p) <= "255")))


def _with_entities(docs: DataFrame) -> DataFrame:
    """id, text -> and the four kinds' spans."""
    t = F.col("text")
    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")
    some = lambda gate, pattern: F.when(gate, common.spans_of(t, pattern)).otherwise(none)
    found = docs.select(
        "*",
        some(t.contains("@"), EMAIL).alias("email"),
        some(t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), IP).alias("ip"),
        some(t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), CARD).alias("card"),
        some(t.contains("+"), PHONE).alias("phone"),
    )
    return found.withColumns({
        "ip": F.filter("ip", lambda s: _small_parts(s["match"])),
        "card": F.filter("card", lambda s: F.length(_digits(s["match"])).between(14, 19) & _luhn(_digits(s["match"]))),
        "phone": F.filter("phone", lambda s: F.length(_digits(s["match"])).between(10, 15)),
    })


def _near(text: Column, span: Column, reach: int) -> Column:
    """The whole words within reach of a span, as spans of the text."""
    low = F.greatest(span["start"] - reach, F.lit(0))
    before = text.substr(low + F.lit(1), span["start"] - low)
    after = text.substr(span["end"] + F.lit(1), F.lit(reach))
    n_after, n_text = F.length(after), F.length(text)
    left = F.filter(common.spans_of(before, TERM), lambda s: (s["start"] > 0) | (low == 0))
    right = F.filter(common.spans_of(after, TERM), lambda s: (s["end"] < n_after) | (span["end"] + n_after >= n_text))
    moved = lambda spans, by: F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["match"].alias("match")))
    return F.concat(moved(left, low), moved(right, span["end"]))


def _slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def _slots(known: DataFrame) -> DataFrame:
    """term, disclosure -> one row with an array of slots; a word's slot holds the few terms of its hash."""
    of_slot = known.groupBy(_slot(F.col("term")).alias("slot")).agg(F.collect_list(F.struct("term", "disclosure")).alias("terms"))
    none = F.expr("cast(array() as array<struct<term:string,disclosure:double>>)")
    every = known.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(of_slot, "slot", "left")
    listed = every.agg(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("terms", none).alias("terms")))).alias("all"))
    return listed.select(F.transform("all", lambda x: x["terms"]).alias("slots"))


def _told(text: Column) -> Column:
    """The revealing words that a text holds, with their disclosure; the table is in ``slots``."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))
    return F.flatten(F.transform(words, lambda w: F.filter(F.element_at("slots", _slot(w) + 1), lambda x: x["term"] == w)))


def scan_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, support: int = SUPPORT, generalise: float = GENERALISE, scratch: common.Scratch | None = None) -> DataFrame:
    """Entities and revealing terms of every whole text.

    Returns the id, the text (null: empty), ``spans`` (array<struct<start,rank,kind,end,match>> of kinds email,
    ip, card, phone and term, by start and then in that order) and ``disclosed`` (map from a term's lower-case form to its
    disclosure). One row for each input row, repeated rows and null ids too; an empty table gives an
    empty result; other columns are not read. A revealing word is a span wherever it stands, unless it lies within an
    entity, whose span covers it; a word near two entities is one span. The result reads tables of ``scratch``, the caller's, which
    must last until it has been read (without one: until the driver ends).
    """
    scratch = scratch or common.Scratch(docs.sparkSession)
    docs = common.pick(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    entities = _with_entities(docs)
    any_found = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    holders = scratch.table(entities.where(any_found).withColumn("row", F.monotonically_increasing_id()), "holders")

    each = F.concat(*[F.transform(k, _tagged(k)) for k in KINDS])
    near = holders.select("row", "text", F.explode(each).alias("s")).select("row", F.col("s.kind").alias("kind"), F.explode(_near(F.col("text"), F.col("s"), reach)).alias("w"))
    near = near.select("row", "kind", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.match").alias("match"), F.lower("w.match").alias("term"))
    near = scratch.table(near, "near")

    # a word within reach of several entities of a kind counts once
    together = near.select("row", "kind", "start", "term").distinct().groupBy("kind", "term").agg(F.count("*").alias("k"))
    anywhere = docs.select(F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("w")).select(F.lower("w").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    anywhere = scratch.table(anywhere, "words")
    total = anywhere.agg(F.sum("n")).first()[0]
    together = scratch.table(together, "together")
    content = {r.kind: r.k for r in together.groupBy("kind").agg(F.sum("k").alias("k")).collect()}
    share = F.lit(None).cast("double")
    for kind, k in content.items():
        share = F.when(F.col("kind") == kind, F.lit(k / total)).otherwise(share)
    told = F.log2((F.col("k") / F.col("n")) / share) / -F.log2(share)
    revealing = together.where(F.col("k") >= support).join(anywhere, "term").withColumn("disclosure", told).where((share < 1) & (F.col("disclosure") >= generalise))

    revealing = scratch.table(revealing.select("kind", "term", "disclosure"), "revealing")
    # a term of two kinds: the larger disclosure counts
    known = revealing.groupBy("term").agg(F.max("disclosure").alias("disclosure"))

    empty = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")
    no_terms = F.expr("cast(map() as map<string,double>)")
    kinds = [(k, F.col(k)) for k in KINDS]
    rest = entities.where(~any_found)
    if revealing.isEmpty():
        plain = lambda df: df.select("id", "text", common.in_order(*kinds, ("term", empty)).alias("spans"), no_terms.alias("disclosed"))
        return plain(holders).unionByName(plain(rest)).toDF(id_col, text_col, "spans", "disclosed")

    # a letter run that an entity cuts is a word only beside the entity
    beside = near.join(revealing.select("kind", "term"), ["kind", "term"]).join(known, "term").groupBy("row").agg(
        F.collect_set(F.struct("start", "end", "match")).alias("beside"),
        F.collect_set(F.struct("term", "disclosure")).alias("told_beside"),
    )
    slots = scratch.table(_slots(known), "slots")
    no_told = F.expr("cast(array() as array<struct<term:string,disclosure:double>>)")
    some = holders.join(beside, "row", "left").drop("row").unionByName(rest.withColumns({"beside": empty, "told_beside": no_told}))
    inside = lambda s: F.exists(each, lambda e: (e["start"] <= s["start"]) & (s["end"] <= e["end"]))
    held = lambda w: F.exists("told", lambda x: x["term"] == F.lower(w))
    words = F.when(F.size("told") > 0, F.filter(common.spans_of(F.col("text"), TERM, held), lambda s: ~inside(s))).otherwise(empty)
    out = some.crossJoin(F.broadcast(slots)).withColumn("told", _told(F.col("text"))).drop("slots")
    out = out.withColumn("terms", F.array_union(words, F.coalesce("beside", empty)))
    of_spans = lambda x: F.exists("terms", lambda s: F.lower(s["match"]) == x["term"])
    out = out.withColumn("told", F.filter(F.array_union("told", F.coalesce("told_beside", no_told)), of_spans))
    out = out.select("id", "text", common.in_order(*kinds, ("term", F.col("terms"))).alias("spans"), F.map_from_entries("told").alias("disclosed"))
    return out.toDF(id_col, text_col, "spans", "disclosed")


def _tagged(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, **options) -> DataFrame:
    """The id and the text with entities as [KIND], revealing terms as [WORD], and the plainest of them removed.

    A null text becomes empty; one row for each input row, repeated rows and null ids too; overlapping spans become the mark of
    the first; an empty table gives an empty result; other columns are not read.
    """
    found = scan_personal(docs, id_col, text_col, **options)

    def mark(x: Column) -> Column:
        told = F.element_at("disclosed", F.lower(x["match"]))
        return F.when(x["kind"] != "term", F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).when(told >= remove, F.lit("")).otherwise(F.lit("[WORD]"))

    return found.select(id_col, common.redacted(F.col(text_col), F.col("spans"), mark).alias(text_col))
