"""Numpy helpers that run inside Spark tasks, on the bytes of one Arrow batch.

A text column arrives as one contiguous UTF-8 buffer plus offsets, so words
are found and hashed for a whole slice of documents with array arithmetic
instead of a Python loop.  White space (0x20, 0x09-0x0D) is ASCII and never
part of a multi-byte character, so working on bytes is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20

_rng = np.random.default_rng(20240229)
#: One random odd 64-bit value per byte value.
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept for the life of the worker."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        out[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of a multiplicative hash)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes: first
    row, end row, their bytes, and offsets that start at 0."""
    raw, off = utf8(column)
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, side="right")) - 1)
        yield row, end, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def _space_table() -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


#: True for bytes of words ``[^\x20\x09-\x0D]+``.
WORD_BYTES = _space_table()


def alnum_table() -> np.ndarray:
    """True for bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a lower-cased text."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = True
    table[0x61:0x7B] = True
    table[0x80:] = True
    return table


def lower_table() -> np.ndarray:
    """Maps A-Z to a-z and leaves all other bytes."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def words(raw: np.ndarray, off: np.ndarray, table: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends (byte positions), and for each document the index
    of its first word (one more entry at the end)."""
    n = len(raw)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(off), np.int64)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = table[raw]
    # a word never runs on from one document into the next
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    if len(cuts):
        starts[cuts] = inside[cuts + 1]
        ends[cuts - 1] = inside[cuts]
    first = np.flatnonzero(starts)
    last = np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, off)


def span_hashes(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [first, last) of a code sequence: a
    polynomial over prefix sums, moved to exponent 0, then mixed."""
    prefix = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers(BASE, len(codes)), out=prefix[1:])
    return mix((prefix[last] - prefix[first]) * powers(BASE_INV, len(codes) + 1)[first] + (last - first).astype(np.uint64))


def word_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    return span_hashes(BYTE_CODE[raw], first, last)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's signed long."""
    return np.ascontiguousarray(x).view(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def hash_list(strings: list[str]) -> np.ndarray:
    """word_hashes of given words (for bounded lists such as templates)."""
    raw, off = utf8(pa.array(strings, pa.large_string()))
    return word_hashes(raw, off[:-1].copy(), off[1:].copy())


def lookup(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted, non-empty key array, or -1."""
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == x, at, -1)


def string_column(pieces: list[bytes | str]) -> pa.Array:
    """A string column from UTF-8 bytes."""
    return pa.array(pieces, pa.binary()).cast(pa.string())
