"""Small helpers for Arrow-batched functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def by_slices(fn: Callable[[list, list], dict], schema: pa.Schema, size: int = 256, chars: int = 4_000_000):
    """A mapInArrow function over (key, text) batches; ``fn(keys, texts)`` sees at most ``size`` rows and about
    ``chars`` characters at once (one longer text alone), and returns columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            lo = used = 0
            for i in range(batch.num_rows + 1):
                n = 0 if i == batch.num_rows or not texts[i].is_valid else len(texts[i].as_buffer())
                if i > lo and (i == batch.num_rows or i - lo >= size or used + n > chars):
                    out = fn(keys.slice(lo, i - lo).to_pylist(), texts.slice(lo, i - lo).to_pylist())
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    lo, used = i, 0
                used += n

    return run


def groups(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each group and the group number of each element."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return starts, np.repeat(np.arange(len(sizes)), sizes)
