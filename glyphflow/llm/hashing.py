"""Vectorised word splitting and rolling hashes over Arrow text buffers.

Everything works on the concatenated UTF-8 bytes of a slice of documents, so the
cost per byte is a few numpy passes and no Python object is made per word.  All
hashes are 64 bit, content-only and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Bytes of text that are hashed at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; returns a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def _power(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.full(size, base, dtype=U64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if size <= 2 * SLICE_BYTES:  # of an unusually long document nothing is kept
            _powers[base] = out
        have = out
    return have[:n]


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, by one prefix sum over all values."""
    prefix = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * _power(len(values), _MULTIPLIER), out=prefix[1:])
    at = _power(len(values) + 1, _INVERSE)
    return mix((prefix[ends] - prefix[starts]) * at[starts] + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def _table(word_bytes: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    values = _BYTE_VALUES.copy()
    if lower:
        values[65:91] = values[97:123]
    return word_bytes, values


def _whitespace_words() -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[[9, 10, 11, 12, 13, 32]] = False
    return t


def _alphanumeric_words() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


#: ``[^\x20\x09-\x0D]+`` as it stands
PLAIN = _table(_whitespace_words(), lower=False)
#: the same with A-Z lower-cased
LOWER = _table(_whitespace_words(), lower=True)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z were lower-cased
ALNUM = _table(_alphanumeric_words(), lower=True)


@dataclass
class Words:
    """The words of some documents: byte bounds in ``data``, hashes, and where each document's words begin."""

    data: np.ndarray
    first_row: int
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray  # of the documents, into the words; one more than documents

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def words(self, doc: int) -> list[bytes]:
        a, b = self.offsets[doc], self.offsets[doc + 1]
        raw = self.data.tobytes() if self.n_docs == 1 else self.data[self.starts[a] : self.ends[b - 1]].tobytes() if b > a else b""
        base = 0 if self.n_docs == 1 or b == a else int(self.starts[a])
        return [raw[s - base : e - base] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``length`` words inside one document, and the index of each one's first word."""
        n = len(self.hashes)
        if n < length:
            return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        at = np.arange(n - length + 1)
        room = np.repeat(self.offsets[1:], self.counts)[: len(at)] - at >= length
        at = at[room]
        return ranges_hash(self.hashes, at, at + length), at


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def word_slices(column: pa.Array, kind: tuple[np.ndarray, np.ndarray], slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of the rows of a string column, some rows at a time."""
    data, off = text_buffers(column)
    row, n = 0, len(off) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(off, off[row] + slice_bytes, side="right")) - 1)
        yield _split(data[off[row] : off[to]], off[row : to + 1] - off[row], row, kind)
        row = to


def _split(data: np.ndarray, off: np.ndarray, first_row: int, kind: tuple[np.ndarray, np.ndarray]) -> Words:
    is_word, values = kind
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, first_row, none, none, np.zeros(0, dtype=U64), np.zeros(len(off), dtype=np.int64))
    inside = is_word[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, first_row, starts, ends, ranges_hash(values[data], starts, ends), np.searchsorted(starts, off))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value of each ``width`` consecutive ones, by doubling block lengths."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best = np.arange(len(values))
    span = 1
    while span * 2 <= width:
        a, b = best[: len(best) - span], best[span:]
        best = np.where(values[b] < values[a], b, a)
        span *= 2
    a, b = best[:n], best[width - span : width - span + n]
    return np.where(values[b] < values[a], b, a)
