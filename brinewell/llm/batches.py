"""Arrow batches in slices of a bounded number of bytes, for steps that work on all texts of a batch at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice; a longer text is a slice of its own.
SLICE = 8_000_000


def slices(batches: Iterable[pa.RecordBatch], text: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, end - at)
            at = end
