"""Whole Arrow string columns as numpy arrays of code points, and back, without a call per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8_lengths(points: np.ndarray) -> np.ndarray:
    """Bytes that each code point takes in UTF-8."""
    return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)


def to_codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows end to end, and the n + 1 offsets of the rows. A null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = bytes(memoryview(data)[at[0] : at[-1]]) if data is not None else b""
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    # a row starts at the code point whose bytes start there
    starts = np.cumsum(np.concatenate([[0], utf8_lengths(points)]))
    return points, np.searchsorted(starts, at - at[0])


def from_codepoints(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The string column whose row i has points[offsets[i] : offsets[i + 1]]."""
    points = np.ascontiguousarray(points[offsets[0] : offsets[-1]], np.uint32)
    raw = points.tobytes().decode("utf-32-le").encode("utf-8")
    bytes_at = np.concatenate([[0], np.cumsum(utf8_lengths(points))])[offsets - offsets[0]]
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(bytes_at.astype(np.int64).tobytes()), pa.py_buffer(raw)
    )


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] values, then the same from starts[1], and so on."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - ends + lengths, lengths)
