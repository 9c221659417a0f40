"""Hierarchical multi-length packing.

Documents are routed to the smallest of several context sizes that holds what is left of them
after full windows of the largest size. Windows are packed from the longest tier down; the gap in
a window is filled with the longest shorter documents that fit, and with a cut one when none
fits, so that every window is full. Sequences of one tier make up step groups of equal tokens.

Each task packs its own rows in pools of bounded size and carries the one open window to the next
pool: no shuffle, and a task that is run again gives the same sequences. What is open at the end
of a task is cut at powers of two, so that no sequence has padding.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .words import TokenTable, rows

TIERS = (256, 512, 1024, 2048)
POOL_TOKENS = 2_000_000
GROUP_TOKENS = 65_536
_TOKENIZERS: dict = {}


class Packer:
    """Items are (length, order, document, start); a document is (id, ids)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.items, self.order = sorted(tiers), [], 0

    def put(self, document: tuple, start: int, length: int) -> None:
        self.order += 1
        insort(self.items, (length, self.order, document, start))

    def add(self, documents: list[tuple]) -> Iterator[tuple[int, list]]:
        """Routes documents: full windows of the largest tier leave at once, the rest waits as items."""
        top = self.tiers[-1]
        fresh = []
        for document in documents:
            n = len(document[1])
            full = n - n % top
            for start in range(0, full, top):
                yield top, [(document, start, top)]
            if n > full:
                self.order += 1
                fresh.append((n - full, self.order, document, full))
        self.items = sorted(self.items + fresh)

    def windows(self) -> Iterator[tuple[int, list]]:
        """Full windows as (tier, pieces); an unfinished one goes back to the items."""
        while self.items:
            length, _, document, start = self.items.pop()
            tier = self.tiers[bisect_right(self.tiers, length - 1)]
            pieces, gap = [(document, start, length)], tier - length
            while gap and self.items:
                i = bisect_right(self.items, (gap, self.order + 1)) - 1
                length, _, document, start = self.items.pop(max(i, 0))
                if length > gap:
                    self.put(document, start + gap, length - gap)
                    length = gap
                pieces.append((document, start, length))
                gap -= length
            if gap:
                for document, start, length in pieces:
                    self.put(document, start, length)
                return
            yield tier, pieces

    def rest(self) -> Iterator[tuple[int, list]]:
        """What is left, in sequences of powers of two."""
        left = [(d, s, n) for n, _, d, s in self.items][::-1]
        self.items = []
        total = sum(n for *_, n in left)
        while total:
            size = min(1 << (total.bit_length() - 1), self.tiers[-1])
            total -= size
            pieces, gap = [], size
            while gap:
                document, start, n = left.pop()
                take = min(n, gap)
                if take < n:
                    left.append((document, start + take, n - take))
                pieces.append((document, start, take))
                gap -= take
            yield size, pieces


def pack(docs: DataFrame, tokenizer: str, last_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Packs every document; tokenizer is the path of a tokenizers file that drops white space.

    Returns a row for each piece: the id, start, length, doc_tokens, sequence_id, offset, tier (the
    length of its sequence, a power of two), step_group and ids (binary, little-endian unsigned 32 bit).
    A null or empty text holds only ``last_id`` (no row at all if that is None). Repeated rows and
    null ids are documents of their own; an empty table gives an empty result; other columns are
    not read. Step groups of a tier hold ``group_tokens`` tokens each; the last one of a task may hold less.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    docs = common.pick(docs, id_col, text_col)
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")],
        T.StructField("tier", T.IntegerType()), T.StructField("step_group", T.StringType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        if tokenizer not in _TOKENIZERS:
            _TOKENIZERS[tokenizer] = TokenTable(tokenizer)
        table, packer, n_sequences, in_tier = _TOKENIZERS[tokenizer], Packer(tiers), 0, {}
        id_type = None

        def out(sequences) -> Iterator[pa.RecordBatch]:
            nonlocal n_sequences
            made, size = [], 0
            for tier, pieces in sequences:
                k = in_tier[tier] = in_tier.get(tier, -1) + 1
                group, offset = f"{task}-{tier}-{k // max(1, group_tokens // tier)}", 0
                for (doc_id, ids), start, length in pieces:
                    made.append((doc_id, start, length, len(ids), (task << 33) + n_sequences, offset, tier, group, ids[start : start + length].tobytes()))
                    offset += length
                size += tier
                n_sequences += 1
                if size >= 1 << 20:
                    yield batch(made)
                    made, size = [], 0
            if made:
                yield batch(made)

        def batch(made: list) -> pa.RecordBatch:
            columns = list(zip(*made, strict=True))
            kinds = [id_type, *[pa.int64()] * 5, pa.int32(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

        def typed():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(0).type
                yield b

        waiting = 0
        for ids, texts in rows(typed()):
            documents = list(zip(ids, (x.astype("<u4", copy=False) for x in table.encode(texts, last_id)), strict=True))
            yield from out(packer.add(documents))
            waiting += sum(len(x) for _, x in documents)
            if waiting >= pool_tokens:
                yield from out(packer.windows())
                waiting = 0
        yield from out(packer.windows())
        yield from out(packer.rest())

    return docs.mapInArrow(run, schema)
