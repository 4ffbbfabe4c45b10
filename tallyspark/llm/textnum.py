"""Vectorised text primitives over Arrow string columns, shared by the corpus operators.

A word is a maximal run of bytes other than ASCII white space; under ``normalise`` ASCII letters and
the Latin-1 capitals are lowered and ASCII punctuation is deleted first, so that "The," is "the" and
a run of punctuation alone is no word. A character of three UTF-8 bytes from U+3000 up, or of four
bytes, is a word of its own, since such scripts write no spaces. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base, or of its inverse, modulo 2**64."""
    kept = _powers.get(inverse)
    if kept is None or len(kept) < n:
        a = np.full(max(n, 1 << 16), _BASE_INV if inverse else _BASE, np.uint64)
        a[0] = 1
        kept = np.multiply.accumulate(a)
        if n <= 1 << 22:
            _powers[inverse] = kept
    return kept[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows at most, so that what a task makes of one stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows that hold about ``limit`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j
        i = j


class Words(NamedTuple):
    """Words of consecutive texts: hashes, byte ranges in the texts' common buffer, and first[d]..first[d + 1], those of text d."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, normalise: bool = True) -> Words:
    """All words of the texts data[offsets[d]:offsets[d + 1]]; offsets[0] is 0."""
    b, at, edge = data, None, offsets[:-1]
    if normalise:
        b = _LOWER[b]
        latin = np.flatnonzero(b[:-1] == 0xC3) + 1
        capital = latin[(b[latin] >= 0x80) & (b[latin] <= 0x9E) & (b[latin] != 0x97)]
        b[capital] += 0x20
        at = np.flatnonzero(~_PUNCT[b])
        b, edge = b[at], np.searchsorted(at, edge)
    n = len(b)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64))
    solid = ~_SPACE[b]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    wide = b >= 0xE3
    if wide.any():
        begins |= wide & solid
        fresh = solid & ((b & 0xC0) != 0x80)
        begins[3:] |= fresh[3:] & wide[:-3] & (b[:-3] < 0xF0)
        begins[4:] |= fresh[4:] & (b[:-4] >= 0xF0)
    inner = edge[edge < n]
    begins[inner] = solid[inner]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(stop) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((b + np.uint64(1)) * powers(n), out=total[1:])
    hashes = mix((total[end] - total[start]) * powers(n + 1, inverse=True)[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    first = np.append(np.searchsorted(start, edge), len(start))
    return Words(hashes, start if at is None else at[start], end if at is None else at[end - 1] + 1, first)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each of the len(h) - n + 1 places."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h)), out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(len(h) - n + 1, inverse=True))


def suffix_ranks(symbols: np.ndarray, keep_all: bool = True) -> list[tuple[int, np.ndarray]]:
    """Prefix doubling over dense symbols from 0 up. Returns [(k, ranks)]: suffixes have equal ranks where
    their first k symbols agree; the last entry ranks them all differently, its inverse is the suffix array.
    Only suffixes still tied are sorted again. The end of the sequence comes before every symbol.
    Without keep_all only the last entry is returned."""
    n = len(symbols)
    if not n:
        return [(1, np.zeros(0, np.int64))]
    counts = np.bincount(symbols)
    rank = (np.cumsum(counts) - counts)[symbols]
    levels, k = [(1, rank)], 1
    tied = np.flatnonzero(counts[symbols] > 1)
    while len(tied):
        follow = tied + k
        key = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        order = np.argsort((rank[tied] << np.int64(32)) | key)
        tied, own, key = tied[order], rank[tied[order]], key[order]
        place = np.arange(len(tied))
        new_group = np.append(True, own[1:] != own[:-1])
        new_part = new_group | np.append(True, key[1:] != key[:-1])
        group_at = np.maximum.accumulate(np.where(new_group, place, 0))
        part_at = np.maximum.accumulate(np.where(new_part, place, 0))
        rank = rank.copy() if keep_all else rank
        rank[tied] = own + part_at - group_at
        k *= 2
        levels = [*levels, (k, rank)] if keep_all else [(k, rank)]
        alone = new_part & np.append(new_part[1:], True)
        tied = np.sort(tied[~alone])
    return levels


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    sa = np.empty(len(ranks), np.int64)
    sa[ranks] = np.arange(len(ranks))
    return sa


def neighbour_lcp(levels: list[tuple[int, np.ndarray]], sa: np.ndarray) -> np.ndarray:
    """lcp[i] of the suffixes sa[i] and sa[i + 1], by binary lifting through the doubling levels."""
    n = len(sa)
    a, b = sa[:-1].copy(), sa[1:].copy()
    for k, rank in reversed(levels):
        ok = np.flatnonzero((a < n) & (b < n))
        ok = ok[rank[a[ok]] == rank[b[ok]]]
        a[ok] += k
        b[ok] += k
    return a - sa[:-1]


def dense(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and each value's index among them."""
    order = np.argsort(values)
    s = values[order]
    new = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
    index = np.empty(len(values), np.int64)
    index[order] = np.cumsum(new) - 1
    return s[new], index
