"""Words, lines and their hashes for whole Arrow batches of texts, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = U64(0xD6E8FEB86659FD93)
#: Bytes of text that are held as numpy arrays at once; a longer document is a chunk of its own.
CHUNK = 1 << 20

#: The contract's white space is \x20 and \x09-\x0D.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: First bytes of UTF-8 code points.
IS_HEAD = (np.arange(256) & 0xC0) != 0x80


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits (splitmix64's constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _STEP)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
#: Also merges upper and lower case of Latin-1 letters (and some other letters with each other): for features only.
_BYTE_FOLD = _BYTE_LOWER.copy()
_BYTE_FOLD[0x80:0x9F] = _BYTE[0xA0:0xBF]
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK + 4096)
        for k, base in enumerate((_BASE, _BASE_INV)):
            row = np.full(size, base, U64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=U64)
    return _powers[0], _powers[1]


class Chunk:
    """A run of documents: ``buf`` holds their bytes, ``off`` the borders, ``lo`` the row of the first one."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lo: int):
        self.buf, self.off, self.lo, self.n = buf, off, lo, len(off) - 1

    def words(self, inside: np.ndarray = IS_WORD) -> None:
        """Sets start, end: the words' bytes; first: the first word of each document and the end; count."""
        here = inside[self.buf]
        n = len(self.buf)
        heads = np.zeros(n + 1, bool)
        heads[self.off] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = here[:-1]
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = here[1:]
        self.start = np.flatnonzero(here & (~before | heads[:-1]))
        self.end = np.flatnonzero(here & (~after | heads[1:])) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each \\n-split line."""
        cut = np.flatnonzero(self.buf == 10)
        start = np.concatenate([self.off[:-1], cut + 1])
        end = np.concatenate([cut, self.off[1:]])
        doc = np.concatenate([np.arange(self.n), np.searchsorted(self.off, cut, "right") - 1])
        end_doc = np.concatenate([doc[self.n :], np.arange(self.n)])
        a, b = np.lexsort((start, doc)), np.lexsort((end, end_doc))
        return start[a], end[b], doc[a]

    def prefix(self, lower: bool, fold: bool = False) -> None:
        power, _ = _power(len(self.buf))
        self._sums = np.zeros(len(self.buf) + 1, U64)
        np.cumsum((_BYTE_FOLD if fold else _BYTE_LOWER if lower else _BYTE)[self.buf] * power[: len(self.buf)], out=self._sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, equal for equal bytes (equal but for A-Z case after prefix(lower=True))."""
        inverse = _power(len(self.buf))[1]
        return mix((self._sums[end] - self._sums[start]) * inverse[start] + (end - start).astype(U64) * _STEP)

    def totals(self, marks: np.ndarray) -> np.ndarray:
        """Sums of a mark for each byte, by document."""
        sums = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(marks, out=sums[1:])
        return np.diff(sums[self.off])


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """An Arrow text column as Chunks of about ``limit`` bytes. Null texts are empty."""
    column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield Chunk(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lo)
        lo = hi


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(width):
        out = out * _BASE + hashes[k : k + n]
    return mix(out)


def shingle_sets(chunk: Chunk, width: int) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its ``width``-word shingles, lower-casing A-Z.

    A document with fewer words has its whole sequence as one shingle; one without words has an empty set.
    """
    chunk.words()
    chunk.prefix(lower=True)
    words = chunk.hashes(chunk.start, chunk.end)
    runs = windows(words, width)
    sets = []
    for d in range(chunk.n):
        a, b = chunk.first[d], chunk.first[d + 1]
        if b - a >= width:
            s = np.sort(runs[a : b - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            sets.append(s[keep])
        elif b > a:
            short = np.full(1, b - a, U64)
            for h in words[a:b]:
                short = short * _BASE + h
            sets.append(mix(short))
        else:
            sets.append(np.zeros(0, U64))
    return sets
