"""Cutting Arrow batches into parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def parts(batch: pa.RecordBatch, texts: list[str], rows: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most ``rows`` rows and, unless a row alone is longer, ``chars`` characters in ``texts``."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in texts:
        size += pc.fill_null(pc.utf8_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        room = (upto[at - 1] if at else 0) + chars
        end = max(at + 1, min(at + rows, int(np.searchsorted(upto, room, side="right"))))
        yield batch.slice(at, end - at)
        at = end
