"""Runs of equal keys over sorted Arrow batches, without holding a run."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Runs:
    """Where runs of equal keys begin; the last key is carried from batch to batch. Nulls are equal."""

    def __init__(self, keys: list[str]):
        self.keys, self.last = keys, None
        self.number = 0  # of runs begun so far
        self.number_before = 0  # before the last batch

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        """Rows of the batch at which a run begins; row 0 only when it does not go on with the run before."""
        n, self.number_before = batch.num_rows, self.number
        if not n:
            return np.zeros(0, np.int64)
        new = np.zeros(n, bool)
        for k in self.keys:
            codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        first, last = (tuple(batch.column(k)[i].as_py() for k in self.keys) for i in (0, n - 1))
        new[0] = self.last is None or first != self.last
        self.last, starts = last, np.flatnonzero(new)
        self.number += len(starts)
        return starts
