"""Vectorised word and shingle hashing over Arrow text columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; that equals the
pattern ``[^\\x20\\x09-\\x0D]+`` on the decoded text, as UTF-8 continuation
bytes never have these values. Words hash to 64 bits by a polynomial over
their bytes, finished by a mixer. Memory: about 60 bytes for each byte of a
segment of ``SEGMENT`` bytes, and 8 bytes for each word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 16
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def lowered(part: np.ndarray) -> np.ndarray:
    """Bytes with A to Z in lower case."""
    return part + (((part - np.uint8(65)) < 26).view(np.uint8) << 5)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 0 to n - 1 at least: powers of the base, of its inverse, and what a word of that size adds to its bytes' sum (each byte counts one more)."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * SEGMENT)
        made = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, _U)
            p[0] = 1
            made.append(np.cumprod(p, dtype=_U))
        made.append(np.concatenate((np.zeros(1, _U), np.cumsum(made[0], dtype=_U)[:-1])) + np.arange(size, dtype=_U) * _U(0xD6E8FEB86659FD93))
        _powers[:] = made
    return _powers[0], _powers[1], _powers[2]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (one more than rows) of a text column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _segments(data: np.ndarray, offs: np.ndarray):
    """Byte ranges of about SEGMENT bytes that end where a text ends or at white space."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + SEGMENT, n)
        if hi < n:
            k = int(np.searchsorted(offs, hi, side="right")) - 1
            if offs[k] > lo:
                hi = int(offs[k])
            else:
                end = int(offs[k + 1])
                while hi < end and not IS_SPACE[data[hi]]:
                    hi += 1
        yield lo, hi
        lo = hi


def span_hashes(part: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges s to e of part."""
    p, inv, by_size = _power_tables(len(part) + 1)
    total = np.empty(len(part) + 1, _U)
    total[0] = 0
    np.multiply(part, p[: len(part)], out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    return mix((total[e] - total[s]) * inv[s] + by_size[e - s])


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool, spans: bool = False):
    """(first, hashes[, starts, ends]): words first[i]:first[i+1] are those of text i."""
    hashes, starts, ends = [], [], []
    for lo, hi in _segments(data, offs):
        part = data[lo:hi]
        blank = (part == 0x20) | ((part - np.uint8(9)) < 5)
        begin = np.zeros(hi - lo + 1, bool)
        begin[offs[np.searchsorted(offs, lo) : np.searchsorted(offs, hi)] - lo] = True
        begin[0] = begin[-1] = True
        word = ~blank
        at = word.copy()
        at[1:] &= blank[:-1] | begin[1:-1]
        to = word.copy()
        to[:-1] &= blank[1:] | begin[1:-1]
        s, e = np.flatnonzero(at), np.flatnonzero(to) + 1
        hashes.append(span_hashes(lowered(part) if lower else part, s, e))
        starts.append(s + lo)
        if spans:
            ends.append(e + lo)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    all_starts = cat(starts, np.int64)
    first = np.searchsorted(all_starts, offs)
    return (first, cat(hashes, _U), all_starts, cat(ends, np.int64)) if spans else (first, cat(hashes, _U))


def distinct_runs(data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a word of each kind, kind of each word): words of one hash are one kind if their bytes agree too."""
    order = np.argsort(hashes)
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    at, which = order[new], np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    size = ends - starts
    place = np.flatnonzero(~IS_SPACE[data])
    if (size != size[at][which]).any() or (data[place] != data[place - np.repeat(starts - starts[at][which], size)]).any():
        at = which = np.arange(len(hashes))
    return at, which


def spread(own: np.ndarray, which: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the values of each word one after the other, where each word's begin and the last one's end); flat holds own[k] values for each kind k."""
    head = np.concatenate((np.zeros(1, np.int64), np.cumsum(own)))
    many = own[which]
    edge = np.concatenate((np.zeros(1, np.int64), np.cumsum(many)))
    return flat[np.repeat(head[:-1][which] - edge[:-1], many) + np.arange(edge[-1])], edge


_FACTORS = mix(np.arange(1, 65, dtype=_U)) | _U(1)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, across texts too."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, _U)
    for j in range(k):
        out += hashes[j : j + n] * _FACTORS[j % 64]
    return mix(out)


def shingle_sets(first: np.ndarray, hashes: np.ndarray, k: int):
    """For each text, the sorted distinct hashes of its k-word shingles.

    A text with fewer words has one shingle, the whole of it; one without words none.
    """
    runs = windows(hashes, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            yield windows(hashes[a:b], b - a)
        else:
            yield hashes[:0]


#: What operators hold in a worker between tasks: name -> function that drops it.
HELD: dict[str, Callable[[], None]] = {}


def small_batches(batches, at: int = 1, most: int = 4 << 20, keeps: str = ""):
    """The record batches cut into slices whose text column (at) has about `most` bytes, or one longer text.

    Workers live on between stages: at the start, what other operators hold
    than the one that is named in `keeps` is dropped; at the end, memory is given back.
    """
    for name, drop in HELD.items():
        if name != keeps:
            drop()
    release()
    for b in batches:
        _, offs = text_buffers(b.column(at))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi
    release()


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
