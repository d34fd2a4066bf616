"""Vectorised word tables over Arrow string columns.

A column of texts is one run of UTF-8 bytes with offsets. Finding words and hashing them are array operations on
that run, a few megabytes at a time, so no text is cut and memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1


def byte_class(is_member) -> np.ndarray:
    return np.array([bool(is_member(b)) for b in range(256)])


#: Bytes of words that white space [\x20\x09-\x0D] separates.
NOT_SPACE = byte_class(lambda b: b not in (9, 10, 11, 12, 13, 32))
#: Bytes of words made of ASCII letters and digits and of all characters beyond ASCII.
ALNUM = byte_class(lambda b: b >= 128 or chr(b).isalnum())
#: A-Z to a-z, other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about limit bytes; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of all words, and for each row the index of its first word, with the total last."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = member[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin, end = offsets[:-1], offsets[1:] - 1
    begin, end = begin[begin < len(data)], end[end >= 0]
    first[begin], last[end] = inside[begin], inside[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words that depend on their bytes alone."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = CHUNK_BYTES
    while size < len(data):
        size *= 2
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of each element with the next; one less than h has."""
    return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ np.uint64(0xD1B54A32D192ED03)))


def runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of runs of length neighbours."""
    if len(h) < length:
        return h[:0]
    out, n = h[: len(h) - length + 1].copy(), len(h) - length + 1
    for k in range(1, length):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + (h[k : k + n] ^ np.uint64(0xD1B54A32D192ED03)))
    return out


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
