"""Arrow columns in runs of bounded size, so a task's memory doesn't grow with its batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts, and items of lists, that are Python objects or arrays at once; a longer row is a run of its own.
RUN_BYTES, RUN_ITEMS = 2 << 20, 1 << 18


def runs(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows of about ``most`` in all."""
    ends, at = np.cumsum(lengths, dtype=np.int64), 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, to - at
        at = to


def list_runs(batches: Iterator[pa.RecordBatch], column: str, most: int = RUN_ITEMS) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, with about ``most`` items of a list column at once."""
    for batch in batches:
        for at, n in runs(np.diff(batch.column(column).offsets.to_numpy()), most):
            yield batch.slice(at, n)
    pa.default_memory_pool().release_unused()


def mapped(texts: pa.Array, f: Callable[[str], str], most: int = RUN_BYTES) -> pa.Array:
    """``f`` of each text; null stays null."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    done = [pa.array([], texts.type)]
    for at, n in runs(lengths, most):
        done.append(pa.array([None if t is None else f(t) for t in texts.slice(at, n).to_pylist()], texts.type))
    return pa.concat_arrays(done)
