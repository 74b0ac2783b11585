"""The bytes of an Arrow string column as one numpy array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends): row i is data[starts[i]:ends[i]] in UTF-8; null rows are empty.

    ``data`` holds the bytes of these rows alone, also where the column is a slice of a longer one. Nothing is copied.
    """
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    valid, offsets, data = column.buffers()
    n, width = len(column), 8 if large else 4
    if not n:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), empty, empty
    at = np.frombuffer(offsets, np.int64 if large else np.int32, n + 1, column.offset * width).astype(np.int64)
    starts, ends = at[:-1], at[1:].copy()
    if column.null_count:
        null = column.is_null().to_numpy(zero_copy_only=False)
        ends[null] = starts[null]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first, last = int(starts[0]), int(at[-1])
    return raw[first:last], starts - first, ends - first


def text_slices(batches, at: int, size: int):
    """Batches of about ``size`` bytes of text in the column ``at``, so that what is made of the texts stays small."""
    for b in batches:
        _, starts, ends = text_bytes(b.column(at % b.num_columns))
        total, first = np.cumsum(ends - starts), 0
        while first < b.num_rows:
            before = total[first - 1] if first else 0
            stop = max(first + 1, int(np.searchsorted(total, before + size, side="right")))
            yield b.slice(first, stop - first)
            first = stop
