"""Words of many texts at once, as 64-bit hashes (numpy over Arrow's buffers, no Python object a word)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_rng = np.random.default_rng(20240521)
#: A random value for each byte; upper-case A-Z have those of lower case in the second table.
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd, and 3 mod 8, so that differences of powers keep few factors of two.
BASE = 0x9E3779B97F4A7C1B
INVERSE = pow(BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, _U)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix(h: np.ndarray) -> np.ndarray:
    """Prefix sums for spans()."""
    out = np.zeros(len(h) + 1, _U)
    np.cumsum(h * powers(BASE, len(h)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of h[start:end] wherever they stand, from h's prefix()."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of each text; nulls are empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def words(column: pa.Array, lower: bool, most: int = 1 << 20):
    """(first row, row after the last, hashes of words, firsts) for runs of rows of about `most` bytes."""
    data, at = strings(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, *_words(data[at[i] : at[j]], at[i : j + 1] - at[i], _LOWER if lower else _BYTE)
        i = j


def _words(b: np.ndarray, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(b):
        return np.zeros(0, _U), np.zeros(len(at), np.int64)
    inside = ~_SPACE[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[at] = True
    before = np.empty(len(b), bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    last = np.empty(len(b), bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    end = np.flatnonzero(inside & (last | edge[1:])) + 1
    sums = np.zeros(len(b) + 1, _U)
    np.cumsum(values[b] * powers(BASE, len(b)), out=sums[1:])
    return spans(sums, start, end), np.searchsorted(start, at)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
