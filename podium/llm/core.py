"""Hashes of words, lines and spans of whole texts, computed in numpy inside Spark tasks.

A batch of texts is walked in chunks of about one megabyte (a longer text is a chunk of its own), so the
memory of a task follows its longest text, not its partition. The hash of bytes i..j is the polynomial
``sum(T[byte] * B**k)`` modulo 2**64, read off a running sum and finished by an avalanche step: every span
costs one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
STEP = U(0xD6E8FEB86659FD93)
#: space, tab, newline, vertical tab, form feed, carriage return
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

_powers = (np.ones(1, U), np.ones(1, U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse for i below at least n."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), CHUNK_BYTES)
        made = []
        for base in (BASE, BASE_INVERSE):
            steps = np.full(size, base, U)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _powers = tuple(made)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("", column.type))
    if len(column) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def starts_of(offsets: np.ndarray, n: int) -> np.ndarray:
    marks = np.zeros(n + 1, bool)
    marks[offsets] = True
    return marks


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk: byte starts and ends, document of each, first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        inside = ~SPACE[data]
        marks = starts_of(offsets, n)
        first = inside.copy()
        first[1:] &= ~inside[:-1] | marks[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | marks[1:n]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)


def running(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, one longer than the data."""
    pow_, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(TABLE[data] * pow_[:len(data)], out=sums[1:])
    return sums


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end)."""
    _, inverse = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * STEP)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; the caller drops those that cross a document's end."""
    size = max(len(words) - n + 1, 0)
    out = np.zeros(size, U)
    for j in range(n):
        out *= STEP
        out += words[j:j + size]
    return mix(out)


def whole(words: Words, n: int) -> np.ndarray:
    """Positions whose n words lie in one document."""
    last = np.repeat(words.first[1:], words.counts)
    at = np.arange(len(words.starts))
    return at[at + n <= last]


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[offsets])


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask over n places of those within ``length`` places of a start."""
    edge = np.zeros(n + length + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:n]) > 0


def bucket(doc_id: np.ndarray) -> np.ndarray:
    """A stable 64-bit hash of document ids."""
    return mix(doc_id.astype(np.int64).view(U) * U(0xA0761D6478BD642F) + U(0xE7037ED1A0B428DB))


TABLE_2 = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def running_2(data: np.ndarray) -> np.ndarray:
    """As ``running``, of an independent second hash."""
    pow_, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(TABLE_2[data] * pow_[:len(data)], out=sums[1:])
    return sums


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines of each text, and the text of each; an empty text has one empty line."""
    marks = np.flatnonzero(data == 0x0A)
    n = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], marks + 1])
    doc = np.concatenate([np.arange(n), np.searchsorted(offsets, marks, "right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.flatnonzero(np.diff(doc, append=n))
    ends[last] = offsets[doc[last] + 1]
    return starts, ends, doc
