"""Words of Arrow string columns as numpy arrays, a bounded piece of the batch at a time.

Everything works on UTF-8 bytes: both word classes of this package are complements of ASCII
sets, so a byte of 0x80 or more always belongs to a word and no decoding is needed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
# Fixed values of the contracts: bytes that words hold.
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
NON_SPACE = np.ones(256, bool)
NON_SPACE[0x20] = NON_SPACE[0x09:0x0E] = False

_BYTE_CODE = np.random.default_rng(20240607).integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Words(NamedTuple):
    """Lower-cased bytes of some texts, and where their words are."""

    data: np.ndarray  # uint8
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # index of each text's first word; one entry more than texts


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and one offset more than texts; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes together; a longer text is a run of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, upto
        at = upto


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal runs of ``kind`` bytes inside each text, after lower-casing A-Z."""
    data = _FOLD[data]
    inside = kind[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    lo, hi = offsets[:-1], offsets[1:]
    full = hi > lo
    before[lo[full]] = False
    after[hi[full] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_CACHE: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    if base not in _CACHE or len(_CACHE[base]) < n:
        _CACHE[base] = _powers(base, max(n, PIECE_BYTES + 1))
    return _CACHE[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``codes`` (uint64), from prefix sums; equal spans, equal hashes."""
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power_table(_BASE, len(codes)), out=total[1:])
    return mix((total[end] - total[start]) * _power_table(_INVERSE, len(codes) + 1)[start] + (end - start).astype(np.uint64))


def word_hashes(w: Words) -> np.ndarray:
    return span_hashes(_BYTE_CODE[w.data], w.start, w.end)


def hash_texts(texts: list[str], kind: np.ndarray) -> list[np.ndarray]:
    """Word hashes of each text, for small lists."""
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    w = words(data, offsets, kind)
    h = word_hashes(w)
    return [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive entries of ``h``."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + h[k : k + n]
    return mix(out + np.uint64(size))


def tidy(run: Callable) -> Callable:
    """``run`` (a mapInArrow function) that gives unused memory back when its task ends.

    Python workers wait for further tasks with what their allocators hold; several of them and the
    executor share one limit.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: it keeps what it likes
                pass

    return wrapped
