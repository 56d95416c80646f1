"""Numpy helpers on batches of texts as UTF-8 bytes: slices of bounded size, polynomial hashes, words, shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that are worked on at a time; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 21

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64. A worker keeps no more than twice as many as it was asked for."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of rows of about ``limit`` bytes; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte times power; ``(s[b] - s[a]) * inverse[a]`` identifies the bytes from a to b."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, in order, and the offsets at which each text's words start.

    Each distinct word is hashed by itself: sums of powers modulo 2^64 collide for some words whatever the base.
    """
    inside = ~IS_SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    starts[bounds] = inside[bounds]
    ends[bounds - 1] = inside[bounds - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    at = np.concatenate([[0], np.cumsum(e - s)])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(LOWER[data[inside]].tobytes())]).dictionary_encode()
    each = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return each[coded.indices.to_numpy(zero_copy_only=False)] if len(s) else np.zeros(0, np.uint64), np.searchsorted(s, offsets)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles; with fewer words, of all its words as one."""
    words, at = word_hashes(offsets, data)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += words[k : k + n] * factors[k]
    rolled = mix(rolled)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            yield mix((words[a:b] * factors[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
