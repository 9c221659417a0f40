"""Scalar functions on bases, reads and k-mers, as Column expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
# Complements of the IUPAC letters; anything else has none.
IUPAC_FROM, IUPAC_TO = "ACGTN0URYKMSWBDHV", "TGCAN0NNNNNNNNNNN"
# Order of extension letters in a packed pair.
EXTENSIONS = "FACTG0"
# 4-bit codes 0..9 of sequence letters ('_' and '0' share 0, 'N' and 'n' share 9); others are 11.
CODES4_FROM, CODES4_TO = "_0acgtACGTNn", "001234567899"
BASES4 = "_acgtACGTN"


def encode_base(c: Column) -> Column:
    """0..3 by the bits of the letter, of any case; N counts as G."""
    x = F.ascii(c)
    high = F.shiftright(x.bitwiseAND(4), 1)
    return high + F.shiftright(high.bitwiseXOR(x.bitwiseAND(2)), 1)


def encode_base_strict(c: Column) -> Column:
    """0..3 of A, C, G, T in either case, null for any other letter."""
    at = F.instr(F.lit(BASES), F.upper(c))
    return F.when(at > 0, at - 1)


def pack(kmer: Column) -> Column:
    """A k-mer of at most 31 bases as a non-negative long that sorts like the string."""
    return F.aggregate(
        F.sequence(F.lit(1), F.length(kmer)), F.lit(0).cast("long"),
        lambda n, i: n * 4 + (F.instr(F.lit(BASES), kmer.substr(i, F.lit(1))) - 1),
    )


def pack_limbs(kmer: Column, width: int = 31) -> Column:
    """A k-mer of any length as longs of ``width`` bases each, in order."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(kmer) - 1) / width).cast("int")), lambda i: kmer.substr(i * width + 1, F.lit(width)))
    return F.transform(parts, pack)


def unpack(code: Column, k: int) -> Column:
    return F.array_join(
        F.transform(F.sequence(F.lit(k - 1), F.lit(0)), lambda i: F.lit(BASES).substr(F.call_function("shiftright", code, i * 2).bitwiseAND(3).cast("int") + 1, F.lit(1))), ""
    )


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; empty for shorter sequences."""
    raw = F.encode(seq, "UTF-8")
    slices = F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.decode(F.substring(raw, i, F.lit(k)), "UTF-8"))
    return F.when(F.length(seq) >= k, slices).otherwise(F.expr("cast(array() as array<string>)"))


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def complement_iupac(c: Column) -> Column:
    """The complement of one letter, N for ambiguity codes, empty for what is no letter of the code."""
    return F.when(F.instr(F.lit(IUPAC_FROM), c) > 0, F.translate(c, IUPAC_FROM, IUPAC_TO)).otherwise("")


def canonical(kmer: Column) -> Column:
    return F.least(kmer, revcomp(kmer))


def flipped(rc: Column, kmer: Column, mine: Column, other: Column) -> Column:
    """An extension as the canonical strand sees it: swapped and complemented where the reverse complement is smaller."""
    return F.when(rc < kmer, F.translate(other, "ACGT", "TGCA")).otherwise(mine)


def minimizer_length(k: int) -> int:
    """m for a k, between 15 and 27 (k must be 15 at least)."""
    if k < 15:
        raise ValueError("minimizers need k of 15 at least")
    return min(27, max(15, k * 2 // 3 + 1))


def minimizer(kmer: Column, k: int, m: int, rc: Column | None = None) -> Column:
    """The greatest of the m-mers, each the lesser of itself and of its reverse complement: the same for both strands."""
    rc = revcomp(kmer) if rc is None else rc
    return F.array_max(F.transform(F.sequence(F.lit(1), F.lit(k - m + 1)), lambda i: F.least(kmer.substr(i, F.lit(m)), rc.substr(F.lit(k - m + 2) - i, F.lit(m)))))


def minimizer_forward(kmer: Column, k: int, m: int) -> Column:
    return F.array_max(F.transform(F.sequence(F.lit(1), F.lit(k - m + 1)), lambda i: kmer.substr(i, F.lit(m))))


def is_clean(kmer: Column) -> Column:
    """Only A, C, G, T in either case."""
    return kmer.rlike("^[ACGTacgt]+$")


def low_quality(c: Column) -> Column:
    return c.rlike("^[acgtn]$")


def valid_inserted(c: Column) -> Column:
    """Letters that a table takes as a neighbour: a base, none (0) or N."""
    return c.rlike("^[ACGT0N]$")


def valid_in_supermer(c: Column) -> Column:
    """Letters that may stand beside a k-mer of a supermer: anything but a separator or N."""
    return ~c.isin("_", "N")


def pack_extensions(left: Column, right: Column) -> Column:
    at = lambda c: F.greatest(F.instr(F.lit(EXTENSIONS), c) - 1, F.lit(0))
    return F.shiftleft(at(left), 3) + at(right)


def unpack_extensions(code: Column) -> Column:
    """struct<left,right>; null if either index is none of the letters."""
    left, right = F.shiftright(code, 3), code.bitwiseAND(7)
    letter = lambda i: F.lit(EXTENSIONS).substr(i + F.lit(1), F.lit(1))
    return F.when((left <= 5) & (right <= 5), F.struct(letter(left).alias("left"), letter(right).alias("right")))


def pack4(seq: Column) -> Column:
    """Two letters a byte as hexadecimal text; an odd last letter is followed by 0."""
    digits = F.translate(F.regexp_replace(seq, f"[^{CODES4_FROM}]", "b"), CODES4_FROM + "b", CODES4_TO + "b")
    # letters b that were in the sequence are outside the code as well
    return F.concat(digits, F.when(F.length(seq) % 2 == 1, "0").otherwise(""))


def slice4(packed: Column, start: Column, n: Column) -> Column:
    """n letters of a packed sequence from the letter ``start`` (from 0) on, packed: an odd start shifts by half a byte, an odd end is followed by 0."""
    part = F.substring(packed, start + 1, n)
    return F.concat(part, F.when(F.length(part) % 2 == 1, "0").otherwise(""))


def unpack4(packed: Column, n: Column) -> Column:
    """The first n letters of a packed sequence; codes beyond the letters become '?'."""
    return F.translate(F.substring(packed, F.lit(1), n), "0123456789b", BASES4 + "?")
