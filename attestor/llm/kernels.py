"""Vectorised byte kernels shared by the corpus operators.

Everything here works on the UTF-8 buffers of one Arrow batch.  A *word* is a
maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; all separators are
ASCII, so words can be found without decoding.  Hashes of words are taken in
chunks of CHUNK bytes, cut anywhere; other kernels cut theirs only where a
function of theirs may, so a text without separators is one chunk to them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; the temporaries take about 40 times this.
CHUNK = 1 << 19
SHINGLE = 5

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_MULT_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_SEEDS = np.random.default_rng(20240607)
_BYTE = _SEEDS.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_POSITION = _SEEDS.integers(1, 2**64 - 1, 16, dtype=np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 4096)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, m, np.uint64)]), dtype=np.uint64) for m in (_MULT, _MULT_INV)]
    return _POWERS[0][:n], _POWERS[1][:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(stops: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Cut [0, len(stops)) near every ``size`` bytes, only before a set position."""
    at, n = 0, len(stops)
    while at < n:
        to = min(at + size, n)
        while to < n and not stops[to]:
            step = stops[to : to + size]
            to = to + int(step.argmax()) if step.any() else min(to + size, n)
        yield at, to
        at = to


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=total[1:])
        return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each document's number of words.

    Chunks are cut anywhere: of a word that goes on in the next one the sums are
    joined, so that a text without separators needs no more memory than another.
    """
    table = _BYTE_LOWER if lower else _BYTE
    sums, lengths, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    heads = offsets[:-1]
    open_ = False  # whether the last chunk ended within a word
    for lo in range(0, len(data), size):
        part = data[lo : lo + size]
        inside, new = ~_SEPARATOR[part], np.zeros(len(part), bool)
        new[heads[np.searchsorted(heads, lo) : np.searchsorted(heads, lo + len(part))] - lo] = True
        starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | new))
        ends = np.flatnonzero(inside & ~np.concatenate([inside[1:] & ~new[1:], [False]])) + 1
        up, down = powers(len(part) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(table[part] * up[: len(part)], dtype=np.uint64)])
            own, length = (total[ends] - total[starts]) * down[starts], ends - starts
            if open_ and inside[0] and not new[0]:  # the first one ends the word before
                last = next(k for k in range(len(sums) - 1, -1, -1) if len(sums[k]))
                sums[last][-1] += np.uint64(pow(int(_MULT), int(lengths[last][-1]), 1 << 64)) * own[0]
                lengths[last][-1] += length[0]
                own, length, starts = own[1:], length[1:], starts[1:]
        sums.append(own)
        lengths.append(length)
        places.append(starts + lo)
        open_ = bool(inside[-1])
    at = np.searchsorted(np.concatenate(places), offsets)
    with np.errstate(over="ignore"):
        return mix64(np.concatenate(sums) + np.concatenate(lengths).astype(np.uint64)), np.diff(at)


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each document's distinct shingle hashes, sorted.

    A document of fewer words than ``size`` has its whole sequence as its one
    shingle; one without words has none.
    """
    n = len(hashes)
    with np.errstate(over="ignore"):
        mixed = mix64(hashes)
        total = np.zeros(max(0, n - size + 1), np.uint64)
        for j in range(size):
            total += mixed[j : n - size + 1 + j] * _POSITION[j] if n >= size else np.uint64(0)
        total = mix64(total)
        at = 0
        for count in counts.tolist():
            if count >= size:
                yield np.unique(total[at : at + count - size + 1])
            elif count:
                short = (mixed[at : at + count] * _POSITION[:count]).sum(dtype=np.uint64) + np.uint64(count) * _POSITION[size]
                yield mix64(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += count


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices that gather the runs [start, start+length) one after another."""
    total = int(lengths.sum())
    base = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return base + np.arange(total)


def tidied(task: Callable) -> Callable:
    """A task's generator that gives freed memory back when it ends.

    Spark keeps idle Python workers, whose allocators would keep it.
    """

    def run(*args):
        try:
            yield from task(*args)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return run
