"""Arrow string columns as flat arrays of bytes, for steps that work on a whole batch in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values in order, where each starts and the last ends); null is empty."""
    column = column.cast(pa.large_binary()) if len(column) else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def strings(data: np.ndarray, at: np.ndarray, valid: np.ndarray | None = None, kind: pa.DataType | None = None) -> pa.Array:
    """The inverse: strings (or binaries) of these bytes, null where not valid."""
    nulls = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(kind or pa.string(), len(at) - 1, [nulls, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def rows_of(table: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Strings of the rows of a table of bytes."""
    n, width = table.shape
    return strings(table.reshape(-1), np.arange(n + 1, dtype=np.int64) * width, valid)


def moved(data: np.ndarray, at: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """An array of `size` zeros with each value's bytes at its start."""
    out = np.zeros(size, np.uint8)
    out[np.arange(len(data)) + np.repeat(starts - at[:-1], np.diff(at))] = data
    return out


def cut(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of this column, one row at least."""
    at, begun = bytes_of(batch.column(column))[1], 0
    while begun < batch.num_rows:
        end = max(int(np.searchsorted(at, at[begun] + most, "right")) - 1, begun + 1)
        yield batch.slice(begun, end - begun)
        begun = end
