"""Whole-batch views of Arrow text columns for the numpy operators.

Words are the runs of bytes other than space and 0x09-0x0D; in UTF-8 these
are exactly the runs of characters other than those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Documents are taken together up to this many bytes of text; a longer document is taken alone.
CHUNK_BYTES = 1 << 21
# Bytes of words that are hashed together (one word at least).
HASH_BYTES = 1 << 18

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_PLACE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (all arithmetic modulo 2^64)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together (one document at least)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every document (one more at the end)."""
    solid = ~IS_SPACE[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    first[edge] |= solid[edge]
    last[edge - 1] |= solid[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Rolling:
    """Polynomial hashes of ranges of a sequence, modulo 2^64, by prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        inverse = pow(base, -1, 1 << 64)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * _powers(base, len(values)), out=self.sums[1:])
        self.shift = _powers(inverse, len(values) + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.shift[start]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: the sum of the mixed (byte, place) pairs, mixed with the length.

    A polynomial of the bytes would give words of certain patterns the same
    value modulo 2^64; mixing every byte with its place does not."""
    sizes = ends - starts
    total = np.cumsum(sizes)
    out = np.zeros(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):  # words of a bounded number of bytes together
        done = total[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(total, done + HASH_BYTES, side="right")))
        size = sizes[first:last]
        begin = total[first:last] - size - done
        place = np.arange(total[last - 1] - done)
        letters = raw[place + np.repeat(starts[first:last] - begin, size)].astype(np.uint64)
        place -= np.repeat(begin, size)
        value = mix((place.astype(np.uint64) + np.uint64(1)) * _PLACE + letters)
        out[first:last] = np.add.reduceat(value, begin) + size.astype(np.uint64) * _M1
        first = last
    return mix(out)


def window_hashes(words: np.ndarray, first: np.ndarray, length: int, base: int = 0xD6E8FEB86659FD93
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of ``length`` words inside one document."""
    sizes = np.diff(first)
    counts = np.maximum(sizes - length + 1, 0)
    total = int(counts.sum())
    begin = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total)
    return mix(Rolling(words, base).ranges(begin, begin + length)), begin
