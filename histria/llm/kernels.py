"""Vectorised text kernels over Arrow batches: bounded slices, word boundaries, 64-bit word and n-gram hashes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Text bytes worked on at once. A longer text is a slice of its own; texts are never cut.
SLICE_BYTES = 1 << 20
U64 = np.uint64
_BASE = pow(0x9E3779B97F4A7C15, 3, 1 << 64) | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        step = np.full(max(n, SLICE_BYTES + 1), base, U64)
        step[0] = 1
        got = np.cumprod(step, dtype=U64)
        if n <= SLICE_BYTES + 1:
            _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


class Slice(NamedTuple):
    rows: pa.RecordBatch
    data: np.ndarray  # uint8, the texts one after the other
    off: np.ndarray  # int64, where each text begins, and the end


#: What a Python worker holds from task to task, and how to let go of it. Workers serve all operators in turn.
held: dict[str, Callable[[], None]] = {}


def let_go(keep: str | None = None) -> None:
    """Drop what other operators hold and the tables of powers, and give freed memory back to the machine: there may be more
    workers than cores, and the idle ones count as well."""
    _powers.clear()
    for name in [n for n in held if n != keep]:
        held.pop(name)()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, keep: str | None = None) -> Iterator[Slice]:
    """Consecutive rows with at most `limit` bytes of text in that column (null: empty)."""
    let_go(keep)
    for batch in batches:
        col = batch.column(column)
        if col.null_count:
            col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
        col = col.cast(pa.large_binary())
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        raw = col.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield Slice(batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at])
            at = to
    let_go(keep)


class Words(NamedTuple):
    h: np.ndarray  # 64-bit hash of each word, A-Z lowered
    start: np.ndarray  # byte where it begins
    end: np.ndarray
    off: np.ndarray  # per text, its first word; and the end


def byte_prefix(data: np.ndarray, lower: bool) -> np.ndarray:
    """c[j] = sum over i < j of value(data[i]) * BASE**i, modulo 2**64."""
    c = np.zeros(len(data) + 1, U64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * powers(_BASE, len(data)), out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((c[end] - c[start]) * powers(_BASE_INV, len(c))[start])


def runs(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of bytes that is_word (256 booleans) marks, never across texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = is_word[data]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    cut = off[(off > 0) & (off < n)]
    begins[cut] = mask[cut]
    ends[cut - 1] = mask[cut - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> Words:
    start, end = runs(data, off, is_word)
    return Words(span_hash(byte_prefix(data, True), start, end), start, end, np.searchsorted(start, off))


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: Words as maximal runs without ASCII white space.
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of digits, ASCII letters and every byte of a non-ASCII character.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_GRAM = 0xD6E8FEB86659FD93


def grow(acc: np.ndarray, h: np.ndarray, m: int) -> np.ndarray:
    """From the hashes of the (m-1)-grams at each word (acc) those of the m-grams; one place shorter."""
    return acc[: len(h) - m + 1] * U64(_GRAM) + h[m - 1 :] if len(h) >= m else np.zeros(0, U64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    acc = h
    for m in range(2, n + 1):
        acc = grow(acc, h, m)
    return acc


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min of x[i:i+w]; len(x) - w + 1 values, by doubling."""
    if len(x) < w:
        return x[:0]
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + length[i] - 1, one run after the other."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(total)


def segments_of(counts_off: np.ndarray) -> np.ndarray:
    """Row number of each element, from row offsets."""
    return np.repeat(np.arange(len(counts_off) - 1), np.diff(counts_off))
