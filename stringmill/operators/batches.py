"""Arrow batches in runs of rows, so that what a task holds follows the bytes of a run, not the rows of a batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_SIZE = 1 << 20  # bytes of text, or values of lists, that are handled together


def sliced(batches: Iterable[pa.Array], size: int = SLICE_SIZE) -> Iterator[pa.Array]:
    """All rows of columns of texts or lists, in order, in runs of about ``size``; a longer row ends its run."""
    for batch in batches:
        length = pc.list_value_length if pa.types.is_list(batch.type) else pc.binary_length
        lengths = pc.fill_null(length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        run = (np.cumsum(lengths) - lengths) // size  # by where a row starts
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(batch)]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
