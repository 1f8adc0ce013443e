"""Arrow batches in pieces of bounded size, so that work on whole batches has bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a piece; a single longer text is a piece of its own.
PIECE_BYTES = 4 << 20
#: Keys that a task remembers to skip repeated rows early; what is left of the repetition is dropped by the shuffle after it.
REMEMBERED = 200_000


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with at most ``most`` bytes in the text column, or with one row."""
    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        before = int(size[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end
