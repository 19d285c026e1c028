"""Fixed-size integer tables summed over all tasks of a mapInArrow pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 13
SCHEMA = "chunk long, counts binary"


def chunks(table: np.ndarray):
    """Arrow batches (chunk, counts) of a task's flat table of 32-bit counts."""
    for c in range(0, len(table), CHUNK):
        part = table[c : c + CHUNK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK], pa.int64()), pa.array([part.astype(np.int32).tobytes()], pa.binary())], ["chunk", "counts"])


def _add(pdf):
    import pandas as pd

    total = sum((np.frombuffer(x, np.int32).astype(np.int64) for x in pdf["counts"]), np.int64(0))
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "counts": [total.tobytes()]})


def total(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' tables, on the driver: ``size`` 64-bit numbers whatever the input."""
    out = np.zeros(size, np.int64)
    for row in parts.groupBy("chunk").applyInPandas(_add, SCHEMA).collect():
        got = np.frombuffer(row.counts, np.int64)
        out[row.chunk * CHUNK : row.chunk * CHUNK + len(got)] = got
    return out
