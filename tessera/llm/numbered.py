"""Ids of numbered words in flat arrays, and the list columns of Arrow batches that carry them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class NumberedIds:
    """Ids of the words numbered so far. The first ``first`` numbers are their own ids."""

    def __init__(self, first: int = 0):
        self.first = first
        self.flat, self.starts, self.lengths = np.arange(first, dtype=np.int32), np.arange(first), np.ones(first, np.int64)

    def forget(self, keep: int) -> None:
        """Only the first ``keep`` numbers stay."""
        self.starts, self.lengths = self.starts[:keep].copy(), self.lengths[:keep].copy()
        self.flat = self.flat[: int(self.lengths.sum())].copy()

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of the next words: as many of ``flat`` as ``lengths`` says for each."""
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.flat, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])

    def of(self, numbers: np.ndarray, at_once: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of numbers, and how many ids there are up to each number's last."""
        lengths = self.lengths[numbers]
        parts = [np.zeros(0, np.int32)]
        for low in range(0, len(numbers), at_once):
            own, length = numbers[low : low + at_once], lengths[low : low + at_once]
            within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            parts.append(self.flat[np.repeat(self.starts[own], length) + within])
        return np.concatenate(parts), np.cumsum(lengths)


def list_parts(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values and (relative) offsets of a list column."""
    if not len(column):  # whose buffer of offsets may be missing
        return column.values.slice(0, 0), np.zeros(1, np.int64)
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def lists(offsets, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(offsets, np.int32)), values)
