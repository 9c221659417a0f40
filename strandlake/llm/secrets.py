"""Secret scans with DataFrame functions only.

Three fixed patterns, and by the method named: Shannon entropy in a window that slides over
candidate strings, one threshold for each character class, kept by incremental counts, with
an allow-list that suppresses known harmless shapes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The patterns of the contract, written so that Java's engine scans in one pass.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"  # AKIA[A-Z0-9]+ of 20 characters at least
HEX = r"[0-9a-f]{24,}+"  # [0-9a-f]+ of 24 characters at least
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Character classes, narrowest first: name, the strings that it holds, bits in a window of 20.
CLASSES = [
    ("digits", r"^[0-9]+$", 9.0),
    ("letters", r"^[A-Za-z_/=+-]+$", 4.1),
    ("hex", r"^[0-9a-fA-F]+$", 3.0),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.6),
]
# Harmless shapes: those of a whole candidate, and those that suppress just the stretch that they match.
ALLOW_WHOLE = [
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # UUID
]
ALLOW = [
    r"example|placeholder|changeme|your[_-]?(?:api|secret|token)",
    r"0123456789|abcdefghijklm",
    r"(?:/[a-z]{2,}){3}[a-z/]*",  # paths
]
#: Counts of a window of at most 31 characters take 5 bits each, 12 to a number.
BITS, PER_WORD = 5, 12


def allowed(patterns: list[str]) -> str:
    """One pattern of all that suppress a stretch, in either case."""
    return "(?i:" + "|".join(patterns) + ")"


def _pieces(candidates: Column, whole: list[str], allow: list[str]) -> Column:
    """What the allow-list leaves of the candidates, as spans of the whole text."""
    left = F.filter(candidates, lambda c: ~F.greatest(*[c["match"].rlike(p) for p in whole], F.lit(False), F.lit(False)))
    if not allow:
        return left
    pattern = allowed(allow)

    def cut(c: Column) -> Column:
        gaps = F.split(c["match"], pattern, -1)
        found = F.concat(F.regexp_extract_all(c["match"], F.lit(pattern), F.lit(0)), F.array(F.lit("")))
        pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("skip")))
        moved = lambda x, before: F.struct((c["start"] + before).alias("start"), (c["start"] + before + F.length(x["gap"])).alias("end"), x["gap"].alias("match"))
        return common.bound(pairs, lambda x: F.zip_with(x, common.running(F.transform(x, lambda p: F.length(p["gap"]) + p["skip"]), lambda a, n: a + n), moved))

    return F.flatten(F.transform(left, lambda c: F.when(c["match"].rlike(pattern), cut(c)).otherwise(F.array(c))))


def _entropy_spans(pieces: Column, window: int, classes: list) -> Column:
    """The pieces' stretches whose windows reach the class threshold; spans of the whole text.

    A piece becomes an array of codes once. The counts of the 67 symbols in the window are packed into a few numbers: a step
    takes one symbol out, puts one in and moves the sum of c * log2(c) by their differences, whatever the piece's length.
    """
    if not 1 < window < 1 << BITS:
        raise ValueError(f"a window has 2 to {(1 << BITS) - 1} characters")
    weight = [c * math.log2(c) if c else 0.0 for c in range(window + 1)]
    rise = F.array(*[F.lit(b - a) for a, b in zip(weight, weight[1:])])
    words = -(-len(ALPHABET) // PER_WORD)

    def threshold(s: Column) -> Column:
        out = F.lit(math.inf)
        for _, shape, bits in reversed(classes):
            out = F.when(s.rlike(shape), F.lit(float(bits))).otherwise(out)
        return out

    # a symbol: the number that holds its count, and its place there
    symbol = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    codes = lambda s: F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: (F.floor(symbol(c) / PER_WORD) * 64 + symbol(c) % PER_WORD * BITS).cast("int"))
    word, place = lambda c: F.shiftright(c, 6), lambda c: c.bitwiseAND(63)
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), place(c))
    count = lambda counts, c: F.call_function("shiftright", F.get(counts, word(c)), place(c)).bitwiseAND((1 << BITS) - 1).cast("int")

    def scan(c: Column, code: Column, limit: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            return common.bound(F.struct(F.get(code, i).alias("new"), F.when(i >= window, F.get(code, i - window)).alias("old")), lambda x: moved(state, i, x["new"], x["old"]))

        def moved(state: Column, i: Column, new: Column, old: Column) -> Column:
            gone = old.isNotNull()
            c_old = F.when(gone, count(state["counts"], old)).otherwise(F.lit(0))
            c_new = count(state["counts"], new) - F.when(gone & (old == new), 1).otherwise(0)
            counts = F.transform(state["counts"], lambda n, j: n + F.when(j == word(new), one(new)).otherwise(0) - F.when(gone & (j == word(old)), one(old)).otherwise(0))
            # rise[c] is what the sum gains when a count of c becomes c + 1
            total = state["sum"] + F.get(rise, c_new) - F.when(gone, F.get(rise, c_old - 1)).otherwise(F.lit(0.0))
            return common.bound(total, lambda t: common.bound((i >= window - 1) & (t <= (F.lit(math.log2(window)) - limit) * window), lambda hit: state_of(state, i, counts, t, hit)))

        def state_of(state: Column, i: Column, counts: Column, total: Column, hit: Column) -> Column:
            return F.struct(
                counts.alias("counts"), total.alias("sum"),
                F.when(hit & (state["lo"] < 0), i - (window - 1)).otherwise(state["lo"]).alias("lo"),
                F.when(hit, i + 1).otherwise(state["hi"]).alias("hi"),
            )

        start = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
        return F.aggregate(
            F.sequence(F.lit(0), F.size(code) - 1), start, step,
            lambda z: F.struct(
                (c["start"] + z["lo"]).alias("start"), (c["start"] + z["hi"]).alias("end"),
                F.when(z["lo"] >= 0, F.substring(c["match"], z["lo"] + 1, z["hi"] - z["lo"])).alias("match"),
            ),
        )

    able = F.filter(pieces, lambda c: (F.length(c["match"]) >= window) & (threshold(c["match"]) <= math.log2(window)))
    scanned = lambda c: common.bound(F.struct(codes(c["match"]).alias("code"), threshold(c["match"]).alias("limit")), lambda x: scan(c, x["code"], x["limit"]))
    return F.filter(F.transform(able, scanned), lambda c: c["match"].isNotNull())


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, classes: list = CLASSES, allow: list[str] = ALLOW, allow_whole: list[str] = ALLOW_WHOLE) -> DataFrame:
    """Secrets in every whole text.

    Returns the id, the text (null: empty) and ``spans``, array<struct<start,rank,kind,end,match>>
    of kinds assign, access, hex and entropy, by start and then in that order of kinds.
    One row for each input row, repeated rows too; a null id stays null; an empty table gives an
    empty result; other columns, whatever their names, are not read. Window (2 to 31 characters) and thresholds
    apply to strings of any length, in time that grows with the length. ``allow`` suppresses the stretches that it matches: what is
    left on either side is judged as a candidate of its own; ``allow_whole`` suppresses candidates.
    """
    docs = common.pick(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    found = docs.select("id", "text", _spans(F.col("text"), window, classes, allow, allow_whole).alias("spans"))
    return found.toDF(id_col, text_col, "spans")


def _spans(t: Column, window: int = 20, classes: list = CLASSES, allow: list[str] = ALLOW, allow_whole: list[str] = ALLOW_WHOLE) -> Column:
    """All spans of a text that is never null."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")
    some = lambda gate, pattern, keep=None: F.when(gate, common.spans_of(t, pattern, keep)).otherwise(none)
    entropy = lambda c: F.when(F.size(c) > 0, _entropy_spans(_pieces(c, allow_whole, allow), window, classes)).otherwise(none)
    return common.in_order(
        ("assign", some(t.rlike("(?i)passw|secret|token|api_?key"), ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN_VALUE, 1)) >= 6)),
        ("access", some(t.contains("AKIA"), ACCESS)),
        ("hex", some(t.rlike("[0-9a-f]{24}"), HEX)),
        ("entropy", common.bound(some(t.rlike("[A-Za-z0-9+/_=-]{20}"), CANDIDATE), entropy)),
    )


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """The id, the text with every secret replaced by the mark, and n_secrets.

    A null text becomes empty; one row for each input row, repeated rows and null ids too; overlapping secrets become one
    mark; an empty table gives an empty result; other columns are not read.
    """
    found = scan_secrets(docs, id_col, text_col, **options)
    return found.select(id_col, common.redacted(F.col(text_col), F.col("spans"), mark).alias(text_col), F.size("spans").alias("n_secrets"))


def redacted_documents(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars", mark: str = "[SECRET]", **options) -> DataFrame:
    """The documents with all their columns, secrets replaced by the mark and the count of characters renewed where there are any.

    Rows without secrets stay as they are, null and empty texts too; repeated rows are rows of their own; further columns
    may have any names, even those of text and count in another case; an empty table gives an empty result.
    """
    names = docs.columns
    at, columns = names.index(text_col), [f"_{i}" for i in range(len(names))]
    text = F.col(columns[at])
    found = docs.toDF(*columns).withColumn("spans", _spans(F.coalesce(text, F.lit("")), **options))
    any_found = F.size("spans") > 0
    found = found.withColumn("new", F.when(any_found, common.redacted(text, F.col("spans"), mark)).otherwise(text))
    out = {columns[at]: F.col("new")}
    if count_col in names:
        i = names.index(count_col)
        out[columns[i]] = F.when(any_found, F.length("new").cast(docs.schema[i].dataType)).otherwise(F.col(columns[i]))
    return found.select(*[out.get(c, F.col(c)) for c in columns]).toDF(*names)
