"""Vectorised words of UTF-8 texts, for operators that run in Python workers.

A word is a run of bytes other than space and ``\\x09``-``\\x0D``.  All of these
separators are ASCII, so the bytes of a UTF-8 text can be cut without decoding
it.  A batch of texts is read as one byte array in slices of a few MB, so the
temporary arrays stay small however many texts a batch has; a single longer
text makes a slice of its own.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(start: int, n: int) -> np.ndarray:
    """Numbers ``start`` to ``start + n`` of the splitmix64 sequence."""
    return mix(np.arange(start + 1, start + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


BYTE_KEY = stream(1 << 40, 256)
_place = stream(1 << 41, 4096) | np.uint64(1)


def _place_keys(n: int) -> np.ndarray:
    global _place
    if n > len(_place):
        _place = stream(1 << 41, 2 * n) | np.uint64(1)
    return _place


class Words(NamedTuple):
    """Words of the texts ``first`` to ``first + texts``, in order."""

    first: int
    texts: int
    data: np.ndarray  # bytes of these texts
    bounds: np.ndarray  # start of each text in data, and the end
    start: np.ndarray  # of each word in data
    length: np.ndarray  # of each word in bytes
    text: np.ndarray  # of each word, counted from first


def byte_view(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def slices(column) -> Iterator[Words]:
    if not len(column):
        return
    data, offsets = byte_view(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        own = data[offsets[i] : offsets[j]]
        bounds = offsets[i : j + 1] - offsets[i]
        inside = ~IS_SPACE[own]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        filled = bounds[:-1][bounds[:-1] < bounds[1:]]
        begins[filled] = inside[filled]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[filled[1:] - 1] = inside[filled[1:] - 1]
        start = np.flatnonzero(begins)
        length = np.flatnonzero(ends) + 1 - start
        yield Words(i, j - i, own, bounds, start, length, np.searchsorted(bounds, start, "right") - 1)
        i = j


def hashes(words: Words) -> np.ndarray:
    """64-bit hash of each word with A-Z in lower case."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    first = np.cumsum(words.length) - words.length
    place = np.arange(int(words.length.sum())) - np.repeat(first, words.length)
    at = place + np.repeat(words.start, words.length)
    value = BYTE_KEY[LOWER[words.data[at]]] * _place_keys(int(words.length.max()))[place]
    return mix(np.add.reduceat(value, first) + words.length.astype(np.uint64))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ordered combination of two arrays of hashes."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(0xD1B54A32D192ED03)))
