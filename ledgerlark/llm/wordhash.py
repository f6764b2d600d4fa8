"""Vectorised word splitting and 64-bit hashing of whole Arrow text columns.

All functions work on the raw UTF-8 buffers of an Arrow string array, so a
batch of texts is split and hashed with a few numpy passes and no per-word
Python objects.  A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=_U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes 0x20 and 0x09-0x0D part words.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def tidy(f: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A generator function over batches that gives freed memory back to the system at its end.

    Python workers live on after a task; what their allocators keep counts
    against the executor while other tasks run.
    """

    @functools.wraps(f)
    def run(*args: object, **named: object) -> Iterator:
        yield from f(*args, **named)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and about ``size`` bytes of the column (one row may have more)."""
    if not batch.num_rows:
        return
    _, at = buffers(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(at, at[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _M2
    x = (x ^ (x >> _U(27))) * _M3
    return x ^ (x >> _U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    column = column.cast(pa.large_string()).cast(wide) if pa.types.is_string(column.type) else column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(at, dtype=np.int64, count=n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, dtype=np.uint8, count=hi)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return body, offsets - lo


def words(body: np.ndarray, offsets: np.ndarray, parts: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words: runs of bytes outside ``parts``, never across two texts."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~parts[body]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(body)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes a step."""
    if lower:
        body = _LOWER[body]
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(body) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    size = ends - starts
    out = mix(size.astype(_U) * _M1 + _M2)
    live = np.arange(len(starts))
    at, left = starts, size
    while len(live):
        chunk = eight[at] & _LOW_BYTES[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ mix(chunk + _M1)) * _M1)
        more = left > 8
        if not more.any():
            break
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def word_hashes(body: np.ndarray, offsets: np.ndarray, parts: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and n + 1 offsets into them."""
    starts, ends = words(body, offsets, parts)
    hashes = np.empty(len(starts), dtype=_U)
    for lo in range(0, len(starts), 1 << 20):
        hi = min(lo + (1 << 20), len(starts))
        a, b = int(starts[lo]), int(ends[hi - 1])
        hashes[lo:hi] = hash_spans(body[a:b], starts[lo:hi] - a, ends[lo:hi] - a)
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text of fewer words, but not none, has the hash of its whole sequence.
    """
    body, offsets = buffers(column)
    hashed, at = word_hashes(body, offsets)
    n = len(hashed) - width + 1
    rolled = np.zeros(max(n, 0), dtype=_U)
    for j in range(width if n > 0 else 0):
        rolled = mix((rolled + hashed[j : j + n]) * _M1 + _U(j + 1))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            h = np.full(1, b - a, dtype=_U)
            for w in hashed[a:b]:
                h = mix((h + w) * _M3)
            out.append(h)
        else:
            out.append(np.zeros(0, _U))
    return out
