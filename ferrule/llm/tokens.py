"""Words of whole batches of texts, as numpy arrays, for the operators that run inside Arrow tasks.

Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased; each gets a 64-bit hash (a
polynomial over its bytes, then mixed). Batches are read in chunks of about 1 MB, and a text
longer than that in parts cut at white space, so memory does not follow the longest text (a
single word is never cut).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES, CHUNK_TEXTS = 1 << 20, 256
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def release() -> None:
    """Give memory that is no longer used back to the system; a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def releasing(run):
    """An Arrow pass that releases memory when it ends."""

    def passed(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return passed


class Chunk(NamedTuple):
    """Some texts of a batch: ``texts`` their places in it, ``data`` their bytes, ``ends`` where each ends.

    ``goes_on``: the (only) text has its next part in the next chunk.
    """

    texts: np.ndarray
    data: np.ndarray
    ends: np.ndarray
    goes_on: bool = False


def chunks(column: pa.Array, size: int = CHUNK_BYTES, most: int = CHUNK_TEXTS) -> Iterator[Chunk]:
    """A column of strings (no nulls) in chunks; a text of over ``size`` bytes comes in several."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        to = min(int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1, at + most, n)
        if to > at:
            yield Chunk(np.arange(at, to), data[offsets[at]:offsets[to]], offsets[at + 1:to + 1] - offsets[at])
            at = to
            continue
        start, end = int(offsets[at]), int(offsets[at + 1])
        while start < end:
            stop = min(start + size, end)
            while stop < end and not SPACE[data[stop]]:
                stop += 1
            yield Chunk(np.array([at]), data[start:stop], np.array([stop - start]), stop < end)
            start = stop
        at += 1


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverses(n: int) -> np.ndarray:
    out = np.full(n, pow(int(_BASE), -1, 1 << 64), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES = (_powers(4096), _inverses(4096))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers from 0, and their inverses (modulo 2^64), ``n`` or more."""
    global _TABLES
    if n <= len(_TABLES[0]):
        return _TABLES
    made = _powers(n), _inverses(n)
    if n <= 2 * CHUNK_BYTES:  # a longer word's are not kept
        _TABLES = made
    return made


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(NamedTuple):
    """Where words begin and end in a chunk, the place of each one's text in the chunk, and its hash."""

    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray


def words(chunk: Chunk, hashed: bool = True) -> Words:
    data, n = LOWERED[chunk.data], len(chunk.data)
    none = np.zeros(0, dtype=np.int64)
    if not n:
        return Words(none, none, none, none.astype(np.uint64))
    inside = ~SPACE[data]
    first = np.zeros(n + 1, dtype=bool)  # where a text begins
    first[0] = True
    first[chunk.ends] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = inside & (~before | first[:n])
    begin = np.flatnonzero(starts)
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    text = np.searchsorted(chunk.ends, begin, side="right")
    if not hashed or not len(begin):
        return Words(begin, end, text, none.astype(np.uint64))
    length = end - begin
    # bytes of words only, weighted by their place among all; then the sum of each word, as if weighted by the places in it
    body = data[inside].astype(np.uint64)
    cuts = np.cumsum(length) - length
    power, inverse = _tables(len(body))
    body += np.uint64(1)
    body *= power[:len(body)]
    return Words(begin, end, text, mixed(np.add.reduceat(body, cuts) * inverse[cuts]))
