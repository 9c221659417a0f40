"""How fixed-size tables place and pack keys, as Column arithmetic: probe sequences, tags, packed slots, sizes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the factor that spreads a tag before it is combined with a bucket.
TAG_FACTOR = 0x5BD1E995


def linear_probes(h: Column, n: int, buckets: int) -> Column:
    """h, h + 1, ... modulo the number of buckets."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(h + i, F.lit(buckets)).cast("long"))


def double_probes(h: Column, step: Column, n: int, buckets: int) -> Column:
    """h, h + step, h + 2 step, ..."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(F.pmod(h, F.lit(buckets)) + i * F.pmod(step, F.lit(buckets)), F.lit(buckets)).cast("long"))


def two_choices(first: Column, second: Column, buckets: int) -> Column:
    return F.array(F.pmod(first, F.lit(buckets)).cast("long"), F.pmod(second, F.lit(buckets)).cast("long"))


def xor_choices(h: Column, tag_bits: int, buckets: int) -> Column:
    """Two buckets, each to be had from the other and the tag."""
    bucket, tag = F.shiftright(h, tag_bits), h.bitwiseAND((1 << tag_bits) - 1)
    return two_choices(bucket, bucket.bitwiseXOR(tag * TAG_FACTOR), buckets)


def pack_slot(tag: Column, value: Column, value_bits: int) -> Column:
    """Tag and value in one number; the value keeps its low bits."""
    return F.shiftleft(tag.cast("long"), value_bits).bitwiseOR(value.cast("long").bitwiseAND((1 << value_bits) - 1))


def slot_tag(slot: Column, value_bits: int) -> Column:
    return F.shiftright(slot, value_bits)


def slot_value(slot: Column, value_bits: int) -> Column:
    return slot.bitwiseAND((1 << value_bits) - 1)


def is_empty(slot: Column, value_bits: int) -> Column:
    return slot_tag(slot, value_bits) == 0


def is_tombstone(slot: Column, tag_bits: int, value_bits: int) -> Column:
    return slot_tag(slot, value_bits) == (1 << tag_bits) - 1


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 2^64."""
    if n < 2:
        return False
    small = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    for p in small:
        if n % p == 0:
            return n == p
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in small:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def prime_ladder(growth: float = 1.05, limit: int = 1 << 40) -> list[int]:
    """Table capacities: primes, each the first beyond so much more than the one before."""
    out, n = [], 2
    while n < limit:
        while not is_prime(n):
            n += 1
        out.append(n)
        n = max(n + 1, int(n * growth))
    return out


def prime_capacity(n: int, ladder: list[int], below: bool = False) -> int:
    """The least capacity of at least n, or the greatest of at most n."""
    return ladder[max(0, bisect_right(ladder, n) - 1)] if below else ladder[min(len(ladder) - 1, bisect_left(ladder, n))]


def expected_kmers(n_reads: int, read_length: int, k: int, targets: int) -> int:
    return n_reads * max(0, read_length - k + 1) // targets


def table_slots(n: int, load: float = 0.66, filter_share: float = 1.3) -> tuple[int, int]:
    """(slots of the main table, slots of its filter) for n keys."""
    return int(n / load), int(n * filter_share)


def filter_bytes(n: int, bytes_per_slot: int = 2, room: float = 1.2) -> int:
    return int(n * bytes_per_slot * room)


def level_sizes(slots: int, main_share: float = 0.9) -> list[int]:
    """Main and backing table of a filter."""
    main = int(slots * main_share)
    return [main, slots - main]
