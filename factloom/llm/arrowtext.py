"""Texts as byte buffers: NumPy views of Arrow columns, and Arrow columns made of slices of a buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = 8  # bytes compared at once; a buffer ends with so many spare ones


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, lower-cased A-Z, with spare zeros at the end; and where each string starts (one more for the end)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.zeros(offsets[-1] - offsets[0] + WORD, np.uint8)
    if len(data) > WORD:
        data[:-WORD] = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    data[(data >= 65) & (data <= 90)] += 32
    return data, offsets - offsets[0]


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of a column of strings, of at most ``size`` bytes or one string, each with its first row."""
    lengths = np.diff(np.frombuffer(column.cast(pa.large_binary()).buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1])
    ends = np.cumsum(lengths)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, column.slice(at, to - at)
        at = to


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices one after the other, and where each starts there (one more for the end)."""
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=at[1:])
    return data[np.repeat(start - at[:-1], length) + np.arange(at[-1])], at


def strings(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The slices as a column of strings; they must be UTF-8."""
    joined, at = gather(data, start, length)
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(joined))])


def keys(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first eight bytes of each slice as one number that sorts like them; shorter slices are filled with zeros."""
    view = np.ndarray((len(data) - WORD + 1,), ">u8", data, strides=(1,))
    found = view[start].astype(np.uint64)
    spare = (8 * (WORD - np.minimum(length, WORD))).astype(np.uint64)
    return np.where(length > 0, (found >> np.minimum(spare, np.uint64(63))) << np.minimum(spare, np.uint64(63)), np.uint64(0))
