"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on Arrow string columns inside ``mapInArrow`` tasks.  A batch is cut
into slices of about one megabyte of whole documents (a longer document is a slice of
its own), so memory stays bounded by the slice and the longest document.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the
lower-cased text; everything else separates words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << max(12, (n - 1).bit_length())
        _pow, _inv = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, p, np.uint64)))) for p in (_P, _P_INV))
    return _pow[:n], _inv[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash; returns a new array."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) pieces of a string column, of whole documents."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
    at = 0
    while at < n:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + max_bytes, side="right")))
        yield at, column.slice(at, end - at)
        at = end


def buffers(rows: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the rows (null as empty) and the offsets between them."""
    rows = pc.fill_null(rows.cast(pa.large_string()), "")
    if lower:
        rows = pc.utf8_lower(rows)
    if not len(rows):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = rows.buffers()
    offsets = np.frombuffer(offs, np.int64)[rows.offset : rows.offset + len(rows) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of true bytes; runs end with their row."""
    n = len(mask)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], mask[:-1]))
    after = np.concatenate((mask[1:], [False]))
    starts = np.flatnonzero(mask & (~before | edge[:n]))
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class Words:
    """The words of some rows: byte span, row and 64-bit hash of each."""

    def __init__(self, rows: pa.Array):
        self.data, self.offsets = buffers(rows)
        self.rows = len(rows)
        self.start, self.end, self.row = spans(_IS_WORD[self.data], self.offsets)
        self.hash = mix(span_hash(self.data, self.start, self.end))
        #: first word of each row, and one past the last
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of byte spans, the same wherever the span stands."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return (total[end] - total[start]) * down[start]


def windows(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of n words within one row."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    at = np.flatnonzero(row[: len(h) - n + 1] == row[n - 1 :])
    return mix((total[at + n] - total[at]) * down[at]), at


def run_sums(h: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``run_hash`` takes the hash of any run of words."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(len(h) + 1)[0][: len(h)], out=total[1:])
    return total


def run_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of words, the same wherever the run stands."""
    return mix((total[end] - total[start]) * _powers(len(total))[1][start])


def as_long(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64, copy=False).view(np.int64)
