"""Arrow batches in slices of bounded bytes, so a task's memory doesn't depend on how long its rows' texts are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
SLICE_ROWS = 2048


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES, rows: int = SLICE_ROWS
) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of at most ``rows`` rows and about ``size`` bytes of a text column.

    A longer text is a slice of its own. An empty batch gives one empty slice.
    """
    for batch in batches:
        n = batch.num_rows
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < n or n == at == 0:
            before = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, before + size, "right"))
            to = min(n, at + rows, max(to, at + 1))
            yield batch.slice(at, to - at)
            if not n:
                break
            at = to
    pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A text column's UTF-8."""
    return batch.column(column).cast(pa.binary()).to_pylist()
