"""Arrow batches in pieces of few bytes: what a Python worker holds then depends on no table's size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are worked on, or go back, together.
TOGETHER = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, cut after the row with which a text or binary column reaches ``most`` bytes."""
    for b in batches:
        sizes = np.nan_to_num(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype(float))
        part = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high > low:
                yield b.slice(low, high - low)
        del b
        pa.default_memory_pool().release_unused()
