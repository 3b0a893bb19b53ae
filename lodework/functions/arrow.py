"""Texts in Arrow batches: bounded slices, and their bytes without decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts handled at once by a Python worker, in UTF-8 bytes; one longer text is handled alone.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in order, in batches of about `most` bytes of text; null texts become empty."""
    for batch in batches:
        i = batch.schema.get_field_index(text)
        column = pc.fill_null(batch.column(i).cast(pa.large_string()), "")
        batch = batch.set_column(i, text, column)
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string column without nulls, and the offsets of its rows."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
