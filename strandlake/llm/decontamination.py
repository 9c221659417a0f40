"""Benchmark decontamination by pigeonhole edit matching.

A test item may be altered by a budget of edits, a fixed share of its length. Cut into one piece more than
that, it leaves at least one piece untouched in any altered copy. An Aho-Corasick automaton finds all
pieces in one walk over a text; around the hits Myers' bit-parallel recurrence computes the edit distance.
Short items are looked for as they are, as whole words.
Nothing is shuffled: the items, in blocks of bounded size, go to the texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .words import rows, trim

#: Edits allowed for each normalised character of an item.
RATE = 0.05
#: Items of fewer normalised characters say too little when altered or within a word: exact copies between word boundaries only.
MIN_CHARS = 30
#: Bytes of items in one automaton; more items make more walks, not a larger broadcast.
BLOCK_BYTES = 4_000_000
_MATCHERS: dict = {}


def normal(text: str | None) -> str:
    """NFC, lower case, runs of white space as one space."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return " ".join(text.lower().split())


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of the pattern in the text with at most ``most`` edits, the first of equals."""
    m, masks = len(pattern), defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        h_plus = minus | (full & ~(xh | plus))
        h_minus = plus & xh
        if h_plus & last:
            score += 1
        elif h_minus & last:
            score -= 1
        h_plus = (h_plus << 1) & full
        h_minus = (h_minus << 1) & full
        plus = h_minus | (full & ~(xv | h_plus))
        minus = h_plus & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


#: Scripts that write words without spaces: any place is a boundary.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _within_word(a: str, b: str) -> bool:
    """Whether no word boundary lies between two neighbouring characters, either of which may be empty."""
    joins = lambda c: c and (c == "_" or unicodedata.category(c)[0] in "LMN") and not _UNSPACED.match(c)
    return bool(joins(a) and joins(b))


class Matcher:
    def __init__(self, items: list[tuple], rate: float, min_chars: int):
        self.items, self.automaton = [], ahocorasick.Automaton()
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            whole = len(text) < min_chars
            n, edits = len(self.items), 0 if whole else int(len(text) * rate)
            self.items.append((item_id, text, edits, whole))
            for p in range(edits + 1):
                a, b = p * len(text) // (edits + 1), (p + 1) * len(text) // (edits + 1)
                piece = text[a:b]
                self.automaton.add_word(piece, [*self.automaton.get(piece, []), (n, a)])
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple]:
        """(item id, distance, start, end) of each item's best match in a normalised text."""
        if not self.items:
            return []
        hits, short = defaultdict(set), {}
        for end, (found) in self.automaton.iter(text):
            for n, a in found:
                if self.items[n][3]:
                    start, after = end + 1 - len(self.items[n][1]), end + 1
                    if n not in short and not _within_word(text[max(0, start - 1) : start], text[start]) and not _within_word(text[end], text[after : after + 1]):
                        short[n] = (self.items[n][0], 0, start, after)
                    continue
                # where the item would start if nothing before the piece was altered
                hits[n].add((end, a))
        out = list(short.values())
        for n, places in hits.items():
            item_id, pattern, edits, _ = self.items[n]
            m = len(pattern)
            starts = sorted({end + 1 - (min(m, (i + 1) * m // (edits + 1))) for end, a in places for i in [_piece_of(a, m, edits)]})
            best, k = None, 0
            while k < len(starts):
                first = last = starts[k]
                while k < len(starts) and starts[k] <= last + 2 * edits + 1:
                    last = starts[k]
                    k += 1
                low, high = max(0, first - edits), min(len(text), last + m + edits)
                got = myers(pattern, text[low:high], edits)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], low + got[1])
            if best:
                distance, end = best
                # the start: the best place of the reversed item in the reversed text before the end
                back = myers(pattern[::-1], text[max(0, end - m - distance) : end][::-1], distance)
                out.append((item_id, distance, end - (back[1] if back else m), end))
        return out


def _piece_of(start: int, m: int, edits: int) -> int:
    """The number of the piece that starts there."""
    i = start * (edits + 1) // m
    while i * m // (edits + 1) < start:
        i += 1
    return i


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[list[tuple]]:
    items = common.pick(benchmark, item_col, text_col).toDF("id", "text").where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    return [[(r.id, r.text) for r in dealt.where(F.col("block") == i).orderBy("id", "text").collect()] for i in range(n)]


def _matcher(shared) -> Matcher:
    items, rate, min_chars, key = shared.value
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, rate, min_chars)
    return _MATCHERS[key]


def _shared(spark, items: list[tuple], rate: float, min_chars: int):
    return spark.sparkContext.broadcast((items, rate, min_chars, hash((tuple(items), rate, min_chars))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The test items that each whole text holds, altered by at most ``rate`` edits a character.

    Items of fewer than ``min_chars`` normalised characters are found unaltered, between word boundaries.

    Returns a row for each input row and item found: the id, item_id, distance, and start and end (long, code
    points of the normalised text) of the best match, the first of equals. Null and empty texts or items match nothing;
    null ids and repeated rows are rows of their own; items of one id with several texts give a row for each text; without documents or items the result
    is empty; other columns are not read.
    """
    docs = common.pick(docs, id_col, text_col)
    spark = docs.sparkSession
    item_type = benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, item_type), *[T.StructField(x, T.LongType()) for x in ("distance", "start", "end")]])

    def pass_over(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher, kind = _matcher(shared), None

            def typed():
                nonlocal kind
                for b in batches:
                    kind = b.schema.field(0).type
                    yield b

            for ids, texts in rows(typed()):
                made = [(d, *x) for d, t in zip(ids, texts.to_pylist(), strict=True) for x in matcher.find(normal(t))]
                if made:
                    d, i, *rest = zip(*made, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d, kind), pa.array(i), *[pa.array(x, pa.int64()) for x in rest]], names=schema.names)

        return run

    out = None
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        found = docs.mapInArrow(pass_over(_shared(spark, items, rate, min_chars)), schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, that hold no test item.

    Null and empty texts hold none, null and empty items are held by none; repeated rows are rows of their own; further
    columns may have any names; an empty table gives an empty result, an empty benchmark all documents.
    """
    at = docs.columns.index(text_col)

    def pass_over(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared)
            for b in batches:
                keep = [not matcher.find(normal(t)) for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))
                trim()

        return run

    plain = common.numbered(docs)
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        plain = plain.mapInArrow(pass_over(_shared(docs.sparkSession, items, rate, min_chars)), plain.schema)
    return plain.toDF(*docs.columns)
