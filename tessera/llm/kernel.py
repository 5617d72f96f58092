"""Vectorised text kernels over Arrow buffers, shared by the operators of this subpackage.

Texts arrive as Arrow batches. A kernel looks at the UTF-8 bytes of many texts at once with numpy,
so no Python string is made for a word. Batches are cut into slices of about ``SLICE`` bytes
(never inside a text) to bound memory: a slice needs some forty bytes of work space for each byte
of text, so one single enormous text is the only thing that can raise it.

Hashes are 64 bits wide and the same on every machine and in every run. None is a polynomial: bytes
go through ``mix`` eight at a time and hashes are folded pairwise, so no pattern of a text (such as
Thue-Morse strings) makes two strings share one.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 1 << 18

LONG = 64
_SEED = 0x5EED
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    return mix(a * _FIRST ^ (b * _SECOND ^ b >> _U(32)))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number; beyond the end they are zero."""
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    return np.ndarray(len(data) + 1, np.dtype("<u8"), held, 0, (1,))


def bytes_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[s:e]; equal bytes have equal hashes wherever they stand.

    Up to LONG bytes go eight at a time through ``mix``, so different strings of one size of up to eight
    bytes never share a hash; longer ones are given to xxh3.
    """
    if not len(starts):
        return np.zeros(0, _U)
    size = ends - starts
    at = eights(data)
    most = int(size.max())
    h = mix(size.astype(_U) * _FIRST ^ (at[starts] & _MASKS[np.minimum(size, 8)]))
    live = np.arange(len(size))
    for k in range(8, min(most, LONG), 8):
        live = live[size[live] > k]
        part = at[starts[live] + k] & _MASKS[np.minimum(size[live] - k, 8)]
        h[live] = mix(h[live] * _SECOND ^ part)
    if most > LONG:
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], seed=_SEED)
    return h


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k values from each place on: overlapping halves folded, doubling in size."""
    out, size = h, 1
    while size < k:
        step = min(size, k - size)
        if len(out) <= step:
            return np.zeros(0, _U)
        out, size = fold(out[:-step], out[step:]), size + step
    return out


_LINEAR = mix(np.arange(1, 1 << 13, dtype=_U)) | _U(1)


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k >= 8 bytes from each place on: eights times odd numbers, summed and mixed.

    For finding candidates only; what they decide is compared afterwards.
    """
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    at, out = eights(data), np.empty(n, _U)
    for a in range(0, n, 1 << 14):  # by parts that stay in the cache
        b = min(n, a + (1 << 14))
        h = at[a:b] * _LINEAR[0]
        for i, j in enumerate(range(8, k, 8), 1):
            h += at[a + min(j, k - 8) : b + min(j, k - 8)] * _LINEAR[i]
        out[a:b] = mix(h)
    return out


class Texts:
    """UTF-8 bytes of some texts: ``data[offsets[i]:offsets[i+1]]`` is text i. Nulls are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


    def parts(self, size: int) -> Iterator[Texts]:
        """The texts in pieces of about ``size`` bytes, never cut; ``first`` counts from this one's first text."""
        at = 0
        while at < self.n:
            to = max(at + 1, min(self.n, int(np.searchsorted(self.offsets, self.offsets[at] + size, "right")) - 1))
            yield Texts(self.data[self.offsets[at] : self.offsets[to]], self.offsets[at : to + 1] - self.offsets[at], at)
            at = to


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE) -> Iterator[Texts]:
    """The texts of a column in slices of about ``size`` bytes, in order."""
    yield from Texts(*texts_of(column), 0).parts(size)


def byte_class(separators: str) -> np.ndarray:
    """True for bytes that belong to words; every byte of 0x80 and above does."""
    out = np.ones(256, bool)
    out[[ord(c) for c in separators]] = False
    return out


#: The two word classes of the contracts.
ALNUM = byte_class("".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))
NONSPACE = byte_class(" \t\n\v\f\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """Words of a slice: bytes ``starts:ends`` each; text i has words ``first[i]:first[i+1]``."""

    def __init__(self, texts: Texts, word_byte: np.ndarray, lower: bool):
        self.texts = texts
        self.bytes = LOWER[texts.data] if lower else texts.data
        inside = word_byte[self.bytes]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[texts.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, texts.offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return bytes_hash(self.bytes, self.starts, self.ends)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.counts)

    def join(self, a: int, b: int) -> bytes:
        """Words a..b-1 joined by one space."""
        s, e, d = self.starts, self.ends, self.bytes
        return b" ".join([d[s[i] : e[i]].tobytes() for i in range(a, b)])


def grams(hashes: np.ndarray, first: np.ndarray, k: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive items of each text, their start positions, and the first gram of each text.

    whole_if_short: a text of fewer items, but not none, gives one gram of all of them.
    """
    counts = np.diff(first)
    many = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k)) if whole_if_short else np.zeros(0, np.int64)
    many[short] = 1
    at = np.concatenate(([0], np.cumsum(many)))
    start = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], many)
    every = gram_hash(hashes, k)
    out = every[np.minimum(start, len(every) - 1)] if len(every) else np.zeros(len(start), _U)
    if len(short):
        whole = mix(counts[short].astype(_U) * _FIRST)
        for j in range(k - 1):
            more = np.flatnonzero(counts[short] > j)
            whole[more] = fold(whole[more], hashes[first[short[more]] + j])
        out[at[short]] = whole
    return out, start, at


def sliding_min_pos(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the rightmost least value of each window of w values."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, span = values, np.arange(len(values)), 1
    while span < w:
        step = min(span, w - span)
        m = len(best) - step
        take = best[step : step + m] <= best[:m]
        at = np.where(take, at[step : step + m], at[:m])
        best = np.where(take, best[step : step + m], best[:m])
        span += step
    return at[:n]


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the rightmost least hash of each window of w, by the hashes' high bits: as sliding_min_pos, but faster.

    Positions travel in the low bits, so windows with equal hashes choose equal places wherever they stand.
    """
    low = _U((1 << max(1, len(h)).bit_length()) - 1)
    best, span = h & ~low | low - np.arange(len(h), dtype=_U), 1
    if len(h) < w:
        return np.zeros(0, np.int64)
    while span < w:
        step = min(span, w - span)
        best, span = np.minimum(best[:-step], best[step:]), span + step
    return (low - (best & low)).astype(np.int64)


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _trim():
    """glibc's malloc_trim, or nothing where there is none."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def released(run):
    """run, a function for mapInArrow, that gives memory back to the machine when a task ends: workers serve many tasks."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return whole


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
