"""Vectors of Arrow batches as numpy matrices, and sums of partitions without the driver seeing each."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector of exactly so many components, none null or not finite, and these vectors as doubles."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    right = np.flatnonzero(lengths == size)
    if not len(right) or not size:
        return right, np.zeros((len(right), size))
    flat = column.take(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is not a number
    rows = flat.reshape(-1, size)
    good = np.isfinite(rows).all(axis=1)
    return right[good], rows[good]


def reduce_partitions(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], object], merge: Callable[[object, object], object]):
    """``part`` of every partition, merged in a tree of tasks; None where no partition has anything (``part`` gives None for such)."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = part(batches)
        if found is not None:
            yield pa.record_batch([pa.array([pickle.dumps(found)], pa.binary())], ["part"])

    def both(a, b):
        return b if a is None else a if b is None else merge(a, b)

    parts = rows.mapInArrow(one, "part binary").rdd.map(lambda r: pickle.loads(bytes(r.part)))
    return parts.treeAggregate(None, both, both)
