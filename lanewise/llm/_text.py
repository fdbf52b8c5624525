"""Whole-batch text kernels: words, rolling hashes and sliding minima over Arrow's UTF-8 buffers.

Every function takes the concatenated bytes of some rows and the row offsets, so that one numpy call covers
thousands of documents. A stretch's hash is two polynomials modulo the prime 2**31 - 1, at fixed points, finished with an
avalanche step: the words that collide for every odd base modulo 2**64 don't here, but texts made against these very
points could. Where rows are decided, bytes are compared besides.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
WORD_BASE = U64(0xD1342543DE82EF95)
GRAM_BASE = 0x9E3779B97F4A7C15
P = U64((1 << 31) - 1)
#: Points of the polynomials, two for each of two hashes.
POINTS = ((1186044283, 783652847), (2012744317, 1467125701))
PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but digits and lower-case letters; all bytes of longer code points are word bytes.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def release() -> None:
    """Gives back what Arrow and the C library keep of freed memory, at the end of a task's work; idle workers would keep it."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only one C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(f):
    """A function of batches that releases memory at its end."""

    def run(batches):
        yield from f(batches)
        release()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit values."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo P."""
    x = (x & P) + (x >> U64(31))
    x = (x & P) + (x >> U64(31))
    return np.where(x >= P, x - P, x)


@lru_cache(8)
def _powers(base: int, log: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        out = np.ones(1 << log, np.uint32)
        for k in range(log):
            out[1 << k : 2 << k] = _reduced(out[: 1 << k].astype(U64) * U64(pow(b, 1 << k, int(P))))
        return out

    return run(base), run(pow(base, -1, int(P)))


@lru_cache(4)
def _gram_powers(log: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        out = np.ones(1 << log, U64)
        for k in range(log):
            out[1 << k : 2 << k] = out[: 1 << k] * U64(pow(b, 1 << k, 1 << 64))
        return out

    return run(GRAM_BASE), run(pow(GRAM_BASE, -1, 1 << 64))


class Rolling:
    """Hashes of any stretches of one sequence of small values (below 2**31): prefix sums of value * point**i."""

    def __init__(self, values: np.ndarray, points: tuple[int, int] = POINTS[0]):
        self.points, self.log = points, max(20, int(len(values) + 1).bit_length())
        self.sums = []
        for point in points:
            terms = values * _powers(point, self.log)[0][: len(values)].astype(U64)
            sums = np.empty(len(values) + 1, U64)
            sums[0] = 0
            np.cumsum(terms if values.dtype == np.uint8 and len(values) < 1 << 24 else _reduced(terms), out=sums[1:])
            self.sums.append(sums)

    def stretches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (end - start).astype(U64) * U64(0xA0761D6478BD642F)
        for point, sums, shift in zip(self.points, self.sums, (U64(0), U64(31))):
            h += _reduced(_reduced(sums[end] - sums[start]) * _powers(point, self.log)[1][start].astype(U64)) << shift
        return mix(h)


def byte_grams(raw: np.ndarray, k: int) -> np.ndarray:
    """One value for each start of k bytes, to choose minimisers by; k is small, so plain arithmetic modulo 2**64 does."""
    n = len(raw) + 1 - k
    if n <= 0:
        return np.empty(0, U64)
    up, down = _gram_powers(max(20, int(len(raw) + 1).bit_length()))
    sums = np.empty(len(raw) + 1, U64)
    sums[0] = 0
    np.cumsum(raw * up[: len(raw)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n])


def phrases(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A value for each stretch of some names that are hashes themselves; for likeness, where nothing is decided by it."""
    up, down = _gram_powers(max(20, int(len(values) + 1).bit_length()))
    sums = np.empty(len(values) + 1, U64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64) * U64(0xA0761D6478BD642F))


def names(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A hash of each stretch offs[i]:offs[i + 1]."""
    parts = [Rolling(raw[offs[a] : offs[b]]).stretches(offs[a:b] - offs[a], offs[a + 1 : b + 1] - offs[a]) for a, b in pieces(offs)]
    return np.concatenate(parts) if parts else np.empty(0, U64)


def distinct(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different stretch offs[i]:offs[i + 1] occurs first, in that order, and which of them each is, by their bytes."""
    if len(offs) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    of = string_array(raw, offs).dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.empty(of.max() + 1, np.int64)
    first[of[::-1]] = np.arange(len(of))[::-1]
    return first, of


def alike(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size[i] values from a[i] on equal those from b[i] on."""
    out = np.ones(len(size), bool)
    offs = np.append(0, np.cumsum(size))
    for lo, hi in pieces(offs):
        part = offs[lo : hi + 1]
        same = raw[_places(a[lo:hi], part)] == raw[_places(b[lo:hi], part)]
        out[lo:hi] = np.diff(np.append(0, np.cumsum(~same))[part - part[0]]) == 0
    return out


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string()).fill_null(b"" if binary else "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes each; a longer row is a range of its own."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def spans(raw: np.ndarray, offs: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the number of its first word (n + 1 of them)."""
    n = len(raw)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~separators[raw]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offs)


class Words:
    """Words of some rows: bytes start:end of raw, hash, and first[r]:first[r + 1] for row r."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACE, lower: bool = False, points: tuple[int, int] = POINTS[0]):
        starts, ends, hashes, firsts, seen = [], [], [], [np.zeros(1, np.int64)], 0
        for lo, hi in pieces(offs):
            part = raw[offs[lo] : offs[hi]]
            part = LOWER[part] if lower else part
            s, e, f = spans(part, offs[lo : hi + 1] - offs[lo], separators)
            hashes.append(Rolling(part, points).stretches(s, e) if len(s) else np.empty(0, U64))
            starts.append(s + offs[lo])
            ends.append(e + offs[lo])
            firsts.append(f[1:] + seen)
            seen += len(s)
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.start, self.end, self.hash = join(starts, np.int64), join(ends, np.int64), join(hashes, U64)
        self.first = np.concatenate(firsts)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def grams(self, k: int) -> np.ndarray:
        """A hash of the k words from each word on; those that cross a row's end mean nothing."""
        return grams(self.hash, k)

    def whole(self, k: int) -> np.ndarray:
        """Whether k words of the same row start at each word."""
        return np.arange(len(self)) + k <= np.repeat(self.first[1:], self.counts)


def gram_of(rows: np.ndarray) -> np.ndarray:
    """What grams() gives for the hashes in each row."""
    acc = rows[:, 0].copy()
    for j in range(1, rows.shape[1]):
        acc *= WORD_BASE
        acc += rows[:, j]
    return mix(acc)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes)
    out = np.zeros(n, U64)
    if n >= k:
        acc = hashes[: n - k + 1].copy()
        for j in range(1, k):
            acc *= WORD_BASE
            acc += hashes[j : n - k + 1 + j]
        out[: n - k + 1] = mix(acc)
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbouring values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many stretches one after another, and their offsets."""
    offs = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    out = np.empty(offs[-1], raw.dtype)
    for lo, hi in pieces(offs):  # places take eight times the bytes
        out[offs[lo] : offs[hi]] = raw[_places(start[lo:hi], offs[lo : hi + 1])]
    return out, offs


def _places(start: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.arange(offs[-1] - offs[0]) + np.repeat(start - (offs[:-1] - offs[0]), np.diff(offs))


def spaced(raw: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words each followed by one space, and where each begins."""
    offs = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words.end - words.start + 1, out=offs[1:])
    out = np.empty(offs[-1], np.uint8)
    for lo, hi in pieces(offs):
        out[offs[lo] : offs[hi]] = raw[np.minimum(_places(words.start[lo:hi], offs[lo : hi + 1]), len(raw) - 1)]
    out[offs[1:] - 1] = 0x20
    return out, offs


def string_array(raw: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Stretches of raw that follow each other, as a binary column."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


def sha256(data: bytes | np.ndarray) -> str:
    return hashlib.sha256(data).hexdigest()
