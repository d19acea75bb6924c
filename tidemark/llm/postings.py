"""What a byte-position inverted index needs: signatures as rows of bytes, and runs of equal keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SHORT = 64  # lists up to this length are compared pair by pair in one step for all of them


def signature_bytes(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A binary column of values of one width (no nulls) as a matrix of bytes."""
    if not len(column):
        return np.zeros((0, width), dtype=np.uint8)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.binary())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width)


def starts_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    return starts, np.diff(np.r_[starts, len(key)])


def pairs_in_runs(key: np.ndarray, short: int = SHORT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of all runs up to ``short``, one distance at a time for all of them."""
    starts, lengths = starts_of(key)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(key)) - 1  # rows of the run that come after each row
    i = np.flatnonzero(np.repeat((lengths > 1) & (lengths <= short), lengths))
    for step in range(1, short):
        i = i[left[i] >= step]
        if not len(i):
            return
        yield i, i + step


def whole_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches that are sorted by their first column, cut only between its values."""
    held = None
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = held.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
            if last:
                yield held.slice(0, last).combine_chunks()
                held = held.slice(last)
    if held is not None:
        yield held.combine_chunks()
