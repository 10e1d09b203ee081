"""Slices of Arrow batches, so that Python holds the objects of a few rows at once, whatever a batch has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each; one longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)).astype(np.int64) + 1
        cut = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(size)], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
