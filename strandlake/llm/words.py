"""Whole texts as words: Arrow splits and numbers them, so Python sees each distinct word of a chunk once."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept by one Python worker; of a full table the rarer half is dropped, which costs time and changes nothing.
TABLE_WORDS = 400_000
#: Bytes of text handled at a time.
CHUNK_BYTES = 2_000_000


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def rows(batches: Iterator[pa.RecordBatch], chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[list, pa.Array]]:
    """(ids, texts) of about chunk_bytes, or of one longer text; a null text is empty.

    What the worker's last task and each chunk freed goes back to the system.
    """
    trim()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = pc.fill_null(batch.column(1), "")
        start = size = 0
        for i, n in enumerate(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
            if size and size + n > chunk_bytes:
                yield ids[start:i], texts.slice(start, i - start)
                start, size = i, 0
                trim()
            size += int(n)
        if start < len(ids):
            yield ids[start:], texts.slice(start)
        trim()


def as_bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


def split(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number of each word, distinct words, end of each text among the words); words end at ASCII white space."""
    # 64-bit offsets: a chunk may be one very long text
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    offsets = np.asarray(lists.offsets, np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
    at, ends = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets[1:] - offsets[0]
    if b"" in distinct:  # before, after or in place of words
        real = at != distinct.index(b"")
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        at = at[real]
    return at, distinct, ends


class WordTable:
    """One row of numbers for each word: values(list of new words) -> array of len(words) rows."""

    def __init__(self, values: Callable[[list[bytes]], np.ndarray], limit: int = TABLE_WORDS):
        self.values, self.limit, self.known, self.rows = values, limit, {}, None

    def of(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) + len(new) > self.limit:
                self.known, self.rows, new = {}, None, words
            fresh = self.values(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.rows = fresh if self.rows is None else np.concatenate([self.rows, fresh])
        if not words:
            return self.values([])
        return self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]


#: Not a character whose normal form, lower case and class are beyond doubt: ASCII, and letters of Latin-1 in composed form.
_ODD = re.compile(r"[^!-~À-ÖØ-öø-ÿ\n]|<\|")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")


def _byte_characters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenTable:
    """Token ids of words, made by the tokenizer and kept.

    For a tokenizer that lower-cases, treats white space only as a separator and is byte-level BPE
    (word_bpe_49k), the ids of a text are those of its words at ASCII white space, one after
    another. Words of plain characters go straight to the tokenizer's BPE model, piece by piece; all others
    take the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = TABLE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model, self.characters, self.pieces = self.tokenizer.model, _byte_characters(), {"\n": []}
        self.known: dict = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.offsets = self.lengths = self.counts = np.zeros(0, np.int64)

    def _piece(self, piece: str) -> list[int]:
        coded = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.characters)
        return [t.id for t in self.model.tokenize(coded)]

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each word)."""
        text = b"\n".join(words).decode() + "\n"
        odd: dict = {}
        if _ODD.search(text):
            texts = text.split("\n")
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
            at = np.unique(np.searchsorted(ends, [m.start() for m in _ODD.finditer(text)], "right"))
            for i in at.tolist():
                odd[i] = self.tokenizer.encode(texts[i], add_special_tokens=False).ids
                texts[i] = ""
            text = "\n".join(texts)
        found = _PIECES.findall(text.lower())
        if len(self.pieces) > self.limit // 4:
            self.pieces = {"\n": []}
        for piece in set(found).difference(self.pieces):
            self.pieces[piece] = self._piece(piece)
        made = list(map(self.pieces.__getitem__, found))
        counts = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter(chain.from_iterable(made), np.uint32, int(counts.sum()))
        # words end at line feeds
        ends = np.concatenate([[0], np.cumsum(counts)])[np.flatnonzero(np.fromiter((p == "\n" for p in found), bool, len(found)))]
        counts = np.diff(ends, prepend=0)
        if odd:
            pieces = np.split(flat, ends[:-1])
            for i, ids in odd.items():
                pieces[i], counts[i] = np.array(ids, np.uint32), len(ids)
            flat = np.concatenate(pieces)
        return flat, counts

    def _add(self, words: list[bytes]) -> None:
        flat, counts = self._encode(words)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(flat)), np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.known.update(zip(words, range(len(self.lengths), len(self.lengths) + len(words)), strict=True))
        self.offsets = np.concatenate([self.offsets, self.used + np.cumsum(counts) - counts])
        self.lengths = np.concatenate([self.lengths, counts])
        self.counts = np.concatenate([self.counts, np.zeros(len(words), np.int64)])
        self.used += len(flat)

    def _places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))

    def _halve(self) -> None:
        """Keeps the half that was seen most."""
        keep = np.zeros(len(self.lengths), bool)
        keep[np.argsort(-self.counts, kind="stable")[: self.limit // 2]] = True
        self.known = dict(zip([w for w, k in zip(self.known, keep.tolist(), strict=True) if k], range(int(keep.sum())), strict=True))
        self.lengths, self.counts, starts = self.lengths[keep], self.counts[keep] // 2, self.offsets[keep]
        ends = np.cumsum(self.lengths)
        self.offsets, self.used = ends - self.lengths, int(ends[-1]) if len(ends) else 0
        self.flat = self._gather(starts, self.lengths)

    def _gather(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, texts: pa.Array, last: int | None = None) -> list[np.ndarray]:
        """The ids of each text, and the id ``last`` after them if given."""
        at, distinct, word_ends = split(texts)
        place = self._places(distinct)
        fresh = np.flatnonzero(place < 0)
        if len(self.known) + len(fresh) > self.limit:
            self._halve()
            place = self._places(distinct)
            fresh = np.flatnonzero(place < 0)
        if len(fresh):
            place[fresh] = np.arange(len(self.lengths), len(self.lengths) + len(fresh))
            self._add([distinct[i] for i in fresh.tolist()])
        self.counts[place] += np.bincount(at, minlength=len(distinct))
        place = place[at]
        lengths = self.lengths[place]
        ids = self._gather(self.offsets[place], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[word_ends]
        out, start = [], 0
        for end in ends.tolist():
            own = ids[start:end]
            out.append(own if last is None else np.append(own, np.uint32(last)))
            start = end
        return out
