"""Sums of count vectors that tasks made over all documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veedor.llm.arrays import tidy
from veedor.llm.vocabulary import deflate, inflate

SLICES = 32


def sliced(counts: np.ndarray) -> list[bytes]:
    """A vector as packed slices, in order."""
    return [deflate(x) for x in np.array_split(counts, SLICES)]


def _add(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[k] = total.get(k, 0) + inflate(part)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([deflate(x) for x in total.values()], pa.binary())], ["slice", "counts"])


def added(slices: DataFrame, size: int) -> np.ndarray:
    """The sum of all vectors of ``size`` entries in ``slices`` (slice, counts). The slices are added up
    on the executors; the driver gets one vector, whose size does not depend on the data."""
    rows = slices.repartition(SLICES, "slice").mapInArrow(tidy(_add), "slice int, counts binary").collect()
    found = {r.slice: inflate(r.counts) for r in rows}
    return np.concatenate([found.get(k, none) for k, none in enumerate(np.array_split(np.zeros(size, np.int64), SLICES))])
