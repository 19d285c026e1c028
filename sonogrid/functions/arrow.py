"""Bridge between array columns and NumPy matrices, in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: rows that a kernel sees at once: bounds the memory of spectra
ROWS = 512


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """(rows, n) doubles of a list column whose lists all have n values."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) != len(column) * n:
        raise ValueError("an A-scan's length differs from the header's")
    return values.reshape(len(column), n).astype(np.float64)


def _list(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    if x.ndim == 1:
        return pa.array(x).cast(kind)
    inner = x.reshape(-1, *x.shape[2:])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), _list(inner, kind))


_KINDS = {"double": pa.float64(), "float": pa.float32(), "int": pa.int32(), "tinyint": pa.int8()}


def with_kernel(df: DataFrame, n: int, kernel: Callable, out: dict[str, tuple[str, int]], column: str = "signal", drop: bool = True) -> DataFrame:
    """``df`` with the kernel's results as columns.

    ``kernel`` maps (rows, n) doubles to an array or a tuple of arrays, one for
    each entry of ``out``: name -> (element type, number of list levels).  Narrow:
    no shuffle; select and filter before, as nothing is pushed through.
    """
    kept = [f for f in df.schema.fields if not (drop and f.name == column) and f.name not in out]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                found = kernel(matrix(part.column(column), n))
                found = found if isinstance(found, tuple) else (found,)
                cols = [part.column(c) for c in names] + [_list(np.ascontiguousarray(x), _KINDS[kind]) for x, (kind, _) in zip(found, out.values())]
                yield pa.RecordBatch.from_arrays(cols, [*names, *out])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{c} {'array<' * deep}{kind}{'>' * deep}" for c, (kind, deep) in out.items()]
    return df.mapInArrow(run, ", ".join(types))
