"""Words and word shingles of Arrow text columns, in numpy.

A block of texts is one byte buffer with document bounds; words are found and hashed for
the whole block at once.  Everything here runs inside tasks, on a block of bounded size
(one text is never split, so a longer text makes a longer block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x = x * _M2
    x ^= x >> np.uint64(31)
    return x


def _byte_values() -> np.ndarray:
    """A 64-bit value for each byte, the same for A-Z as for a-z."""
    v = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    v[65:91] = v[97:123]
    return v


BYTE_VALUE = _byte_values()

#: Bytes that separate words: white space, or all that isn't an ASCII letter, digit or non-ASCII.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True
NOT_ALNUM[65:91] = False


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))))
                                  for b in (np.uint64(_BASE), np.uint64(inverse)))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their bounds (n + 1 offsets); a null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def blocks(bounds: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``size`` bytes each, one document at least."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end and hash of each word, and the first word of each document (n + 1 entries)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = ~separator[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    inner = bounds[:-1][bounds[:-1] < n]
    before[inner] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[inner[inner > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    up, down = POWERS.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start])
    return start, end, hashes, np.searchsorted(start, bounds)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words of a document, and the first of each document.

    A document with fewer words, but one at least, has one: the whole sequence.
    """
    count = np.diff(first)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.concatenate(([0], np.cumsum(made, dtype=np.int64)))
    rolled = np.zeros(len(hashes), np.uint64)
    factor = POWERS.upto(n + 1)[0]
    for k in range(n):
        part = hashes[k:] * factor[k + 1]
        rolled[:len(part)] += part
    doc = np.repeat(np.arange(len(count)), made)
    out = rolled[first[:-1][doc] + np.arange(bounds[-1]) - bounds[:-1][doc]]
    for d in np.flatnonzero((count < n) & (count > 0)):
        w = hashes[first[d]:first[d + 1]]
        out[bounds[d]] = (w * factor[1:len(w) + 1]).sum(dtype=np.uint64) + np.uint64(len(w))
    return mix(out), bounds
