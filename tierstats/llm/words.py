"""Words of whole texts as numpy arrays, straight from Arrow's string buffers.

All arrays are over a chunk of rows of bounded size, so tasks need memory for a chunk and not for a partition;
one text is never cut, so the longest text sets the least.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Odd multipliers of the polynomial hashes and the constants of the finaliser (fixed values).
WORD_BASE, WINDOW_BASE, WINDOW_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
WORD_BASE_2 = 0xE7037ED1A0B428DB
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Chunk(NamedTuple):
    """Rows lo..hi of a batch: their text's bytes, where each text starts, words by start and end, and the
    number of each text's first word (one entry more than texts)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)

    def by_doc(self, flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums of ``flags`` between consecutive positions ``at``."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[at[1:]] - total[at[:-1]]


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        own = offs[lo : hi + 1] - offs[lo]
        part = data[offs[lo] : offs[hi]]
        yield Chunk(lo, hi, part, own, *_words(part, own))
        lo = hi


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~IS_SPACE[data]
    filled = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        before[filled] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(inside):
        after[-1], after[:-1] = False, inside[1:]
        after[offsets[1:][np.diff(offsets) > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _tables or len(_tables[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _tables[base] = np.multiply.accumulate(steps)
    return _tables[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = WORD_BASE, piece: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the words, by prefix sums of a polynomial; long data go piece by piece."""
    out, k = np.empty(len(starts), np.uint64), 0
    inverse = pow(base, -1, 1 << 64)
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + piece, "right")))
        a, b = starts[k], ends[stop - 1]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * _powers(base, b - a), out=sums[1:])
        s, e = starts[k:stop] - a, ends[k:stop] - a
        out[k:stop] = mix((sums[e] - sums[s]) * _powers(inverse, b - a)[s] + (e - s).astype(np.uint64))
        k = stop
    return out


def window_hashes(h: np.ndarray, k: int, base: int = WINDOW_BASE) -> np.ndarray:
    """Hash of each k consecutive entries of ``h``; len(h) - k + 1 entries."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(base, len(h)), out=sums[1:])
    n = len(h) - k + 1
    return mix((sums[k:] - sums[:n]) * _powers(pow(base, -1, 1 << 64), n))


def whole_windows(first: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the words that start a window of k words of one text."""
    n = np.diff(first)
    keep = np.ones(first[-1], bool)
    for back in range(1, k):  # the last k - 1 words of each text start none
        at = first[1:] - back
        keep[at[n >= back]] = False
    return np.flatnonzero(keep)
