"""Vectorised reading of texts as UTF-8 bytes: words, their hashes, slices of a batch.

The functions work on numpy arrays inside one task and hold a few arrays of a slice
(`SLICE_BYTES` of text, or one word if that is longer) at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of words that are runs without ASCII white space.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        for base, name in ((_BASE, "_POWERS"), (inverse, "_INVERSE")):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _POWERS, _INVERSE


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(text: np.ndarray, separators: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of bytes that are no separators."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~separators[text]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def range_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal ranges have equal hashes."""
    powers, inverse = _tables(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[:len(text)],
              out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]
               + (ends - starts).astype(np.uint64))


def pieces(text: np.ndarray, separators: np.ndarray,
           size: int = SLICE_BYTES) -> Iterator[np.ndarray]:
    """Cut a text behind separators into pieces of about `size` bytes."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text):
            gap = np.flatnonzero(separators[text[end:end + 65536]])
            if len(gap):
                end += int(gap[0]) + 1
                break
            end = min(end + 65536, len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(text: np.ndarray, separators: np.ndarray = BLANK) -> np.ndarray:
    """Hashes of a text's words in order, letters A-Z read as a-z."""
    found = []
    for piece in pieces(text, separators):
        lower = LOWER[piece]
        found.append(range_hashes(lower, *word_bounds(lower, separators)))
    return found[0] if len(found) == 1 else np.concatenate(found)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as one byte array and its row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type)
                                  or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32,
                            len(column) + 1, column.offset * (8 if wide else 4))
    if data is None:
        return np.zeros(0, np.uint8), offsets.astype(np.int64)
    return np.frombuffer(data, np.uint8), offsets.astype(np.int64)


def rows_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each row, without a copy."""
    data, offsets = as_bytes(column)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[a:b]


def sliced(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES
           ) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about `size` bytes of text each."""
    _, offsets = as_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end
