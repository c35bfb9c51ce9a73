"""Vectorised byte and word kernels shared by the Arrow stages.

A batch of texts is one byte array with offsets. Everything here works on such
arrays in blocks of about BLOCK bytes (a longer text is a block of its own), so
memory follows the longest text, not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
U = np.uint64

_rng = np.random.default_rng(20240229)
#: One random 64-bit value for each byte; the second table lower-cases A-Z.
BYTE_VALUE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
MULTIPLIERS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of words once punctuation is gone: digits, letters, any byte beyond ASCII.
CORE = np.zeros(256, bool)
CORE[48:58] = CORE[65:91] = CORE[97:123] = CORE[128:] = True

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64, for i < n."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * BLOCK)
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]))
        _inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _INVERSE)]))
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(data: np.ndarray, offs: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets) of runs of texts of about ``size`` bytes."""
    first, n = 0, len(offs) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offs, offs[first] + size, "right")) - 1)
        yield first, end, data[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """Sums from which ``span_hash`` reads the hash of any span; one longer than ``data``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, wherever it lies."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64) * MULTIPLIERS[63])


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of ``[^\\x20\\x09-\\x0D]``; runs end at the end of a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before, after = np.empty_like(solid), np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    after[-1], after[:-1] = False, solid[1:]
    start = np.flatnonzero(solid & (~before | cut[:-1]))
    end = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def core_only(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts without punctuation: letters, digits, bytes beyond ASCII and white space."""
    keep = CORE[data] | SPACE[data]
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return data[keep], at[offs]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = LOWER_VALUE) -> np.ndarray:
    return span_hash(prefix_hash(data, table), start, end)


def window_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` neighbours; runs over text borders are the caller's to drop."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, U(width), np.uint64)
    for j in range(width):
        out += hashes[j : n + j] * MULTIPLIERS[j]
    return mix(out)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text of fewer words has its whole sequence as its one shingle, a text
    without words has none.
    """
    start, end, text = words(data, offs)
    hashes = word_hashes(data, start, end)
    runs = window_hash(hashes, width)
    bounds = np.searchsorted(text, np.arange(len(offs)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield window_hash(hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
