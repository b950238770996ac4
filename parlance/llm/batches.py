"""Slices of Arrow batches that bound what one step of Python works on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text per slice; a longer text is a slice of its own.
SLICE_BYTES = 3 << 19


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of ``column`` at most, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 6
        group = np.cumsum(sizes) // most
        edges = np.flatnonzero(np.diff(group, prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)
