"""Whole-column text kernels shared by the operators: words, hashes, windows.

A batch of texts is one byte array plus document offsets (the Arrow layout), and
every function works on all documents of a batch at once.  Words are
``[^\\x20\\x09-\\x0D]+`` unless a function says otherwise; white space is ASCII, so
working on UTF-8 bytes never cuts a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z on bytes; all others unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_U = np.uint64
#: Text bytes handled at once; a longer document is handled alone, whole.  Temporary arrays take about 60 times as much.
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: all output bits depend on all input bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xA0761D6478BD642F)
    x ^= x >> _U(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


class Roller:
    """Hash of any span of a sequence in constant time, modulo 2**64.

    ``h[a:b] = sum(v[j] * base**(j - a))``; equal content gives equal hashes wherever it
    stands.  ``base`` is odd and so has an inverse.  Powers are kept for sequences of up to
    CHUNK_BYTES (16 bytes for each value); those of a longer one go with it.
    """

    def __init__(self, seed: int):
        self.base = int(mix(np.array([seed * 2 + 1], _U))[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def _reserve(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse for ``n`` values."""
        if len(self.up) >= n:
            return self.up, self.down
        size = min(max(n, 2 * len(self.up)), CHUNK_BYTES + 1) if n <= CHUNK_BYTES + 1 else n
        up, down = _powers(self.base, size), _powers(self.inverse, size)
        if n <= CHUNK_BYTES + 1:
            self.up, self.down = up, down
        return up, down

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = self._reserve(len(values) + 1)
        total = np.zeros(len(values) + 1, _U)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return mix((total[end] - total[start]) * down[start])


class Hasher:
    """Word hashes and hashes of word sequences; another seed gives independent ones."""

    def __init__(self, seed: int = 1):
        self.table = mix(np.arange(256, dtype=_U) + _U(seed * 1000 + 1))
        self.bytes, self.words = Roller(seed), Roller(seed + 7919)

    def word(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.bytes.spans(self.table[data], start, end)

    def sequence(self, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.words.spans(words, start, end)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (n + 1, from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count or not pa.types.is_string(column.type):
        column = pc.fill_null(column.cast(pa.large_string()), "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose texts hold about ``limit`` bytes (one row at least)."""
    n, start = batch.num_rows, 0
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    total = np.concatenate([[0], np.cumsum(np.asarray(size, np.int64))])
    while start < n:
        end = max(start + 1, int(np.searchsorted(total, total[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


class Words:
    """Words of a batch of texts.

    ``start``/``end``: byte spans of the words; ``first``: index of each document's first
    word, with the total at the end (documents are ``first[i]:first[i + 1]``).
    """

    def __init__(self, column: pa.Array, separator: np.ndarray = SPACE, fold: bool = False):
        data, self.offsets = utf8(column)
        self.raw = data
        self.data = LOWER[data] if fold else data
        if len(data):
            inside = ~separator[data]
            edge = np.zeros(len(data) + 1, bool)
            edge[self.offsets] = True
            begins, ends = inside.copy(), inside.copy()
            begins[1:] &= ~inside[:-1] | edge[1:-1]
            ends[:-1] &= ~inside[1:] | edge[1:-1]
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of ``length`` words inside one document, and each document's share (n + 1 offsets)."""
        per = np.maximum(self.count - length + 1, 0)
        share = np.concatenate([[0], np.cumsum(per)])
        return np.arange(share[-1]) + np.repeat(self.first[:-1] - share[:-1], per), share

    def owner(self, per: np.ndarray) -> np.ndarray:
        """Document index repeated ``per`` times each."""
        return np.repeat(np.arange(len(per)), per)


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary column from one byte array and n + 1 offsets."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a Spark long."""
    return x.view(np.int64)
