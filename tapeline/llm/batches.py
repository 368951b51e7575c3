"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(
    batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 2 << 20
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, cut so that ``column`` holds about ``most_bytes``.

    A row is never cut: one long text makes a slice of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start, total = 0, len(sizes)
        while start < total:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column; null becomes the empty text, bytes that are not UTF-8 U+FFFD."""
    try:
        return [text or "" for text in batch.column(column).to_pylist()]
    except UnicodeDecodeError:
        raw = batch.column(column).cast(pa.binary()).to_pylist()
        return [(text or b"").decode("utf-8", "replace") for text in raw]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the spans, one after the other."""
    lengths = lengths.astype(np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts.astype(np.int64) - first, lengths)


def vectors_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
