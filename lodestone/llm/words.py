"""Vectorised word spans and word hashes over Arrow text columns.

Whole texts are read as UTF-8 bytes.  Every word definition used by the operators separates words at
ASCII characters only, so a byte is either inside or outside a word and no decoding is needed.  All
arithmetic is modulo 2**64 on numpy arrays, a bounded number of bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are held in numpy arrays at once; one longer document makes a block of its own.
BLOCK_BYTES = 1 << 21

_U = np.uint64
_BYTES = np.arange(256)
#: The word bytes of `[^\x20\x09-\x0D]+`.
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: The word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: The bytes of letters, after A-Z became a-z; every character beyond ASCII counts as one.
LETTER = ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: A-Z to a-z, other bytes unchanged.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): a bijection that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))


class _Powers:
    """base**i and base**-i for i below a growing length."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(0xC2B2AE3D27D4EB4F)


@dataclass
class Words:
    """The words of a block of documents, in order.

    buf: the block's bytes; start, end: each word's span in buf; doc: each word's document, counted
    from 0 in the block; first: index of each document's first word, with the total at the end;
    rows: the documents' places in the column; offsets: where each begins in buf, with the end.
    """

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    rows: slice
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return self.span_hashes()(self.start, self.end)

    def span_hashes(self):
        """A function of arrays of span starts and ends that returns 64-bit hashes of the bytes between."""
        n = len(self.buf)
        up, down = _BYTE_POWERS.get(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_SYMBOL[self.buf] * up[:n], out=total[1:])
        return lambda start, end: mix((total[end] - total[start]) * down[start])

    def text(self, i: int, j: int) -> bytes:
        """Words i to j, j excluded, joined by one space."""
        return b" ".join(self.buf[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j], strict=True))


def rolling(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of `size` consecutive words, by the index of the run's first word."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _WORD_POWERS.get(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(mix(words ^ _U(seed)) * up[:n], out=total[1:])
    return mix((total[size:] - total[: n - size + 1]) * down[: n - size + 1] + _U(size))


def inside(words: Words, size: int) -> np.ndarray:
    """Of every run of `size` consecutive words: whether it lies in one document."""
    n = len(words.start)
    if n < size:
        return np.zeros(0, bool)
    doc = words.doc
    return doc[size - 1 :] == doc[: n - size + 1]


def _spans(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray, rows: slice) -> Words:
    inner = kind[buf]
    before = np.empty_like(inner)
    if len(inner):
        before[0] = False
        before[1:] = inner[:-1]
    edges = offsets[:-1][offsets[:-1] < len(buf)]
    before[edges] = False
    start = np.flatnonzero(inner & ~before)
    after = np.empty_like(inner)
    if len(inner):
        after[-1] = False
        after[:-1] = inner[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    after[lasts] = False
    end = np.flatnonzero(inner & ~after) + 1
    return Words(buf, start, end, np.searchsorted(start, offsets), rows, offsets)


def blocks(column: pa.Array, kind: np.ndarray, lower: bool, limit: int = BLOCK_BYTES) -> Iterator[Words]:
    """The words of a text column, a bounded number of bytes at a time; null texts have no words."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        buf = data[offsets[i] : offsets[j]]
        yield _spans(LOWER[buf] if lower else buf, offsets[i : j + 1] - offsets[i], kind, slice(i, j))
        i = j
