"""Ranks within runs of equal keys over sorted Arrow batches, without holding a run."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class RunRanks:
    """0-based rank of each row in its run of equal keys; the current run is carried from batch to batch."""

    def __init__(self) -> None:
        self.last: object = None
        self.seen = 0  # rows of the current run in earlier batches
        self.started = False

    def __call__(self, keys: pa.Array) -> np.ndarray:
        n = len(keys)
        if n == 0:
            return np.zeros(0, np.int64)
        codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new = np.r_[True, codes[1:] != codes[:-1]]
        first = keys[0].as_py()
        carried = self.seen if self.started and first == self.last else 0
        starts = np.flatnonzero(new)
        rank = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
        if carried:
            rank[: starts[1] if len(starts) > 1 else n] += carried
        self.last, self.seen, self.started = keys[n - 1].as_py(), int(rank[-1]) + 1, True
        return rank


def take(batch: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
    return batch.filter(pa.array(keep)) if not keep.all() else batch


