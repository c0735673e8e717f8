"""Sums over all rows, taken per Arrow batch and added over the partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tamis.functions.vectors import vector_sums
from tamis.session import SMALL_BYTES

CELL_SUMS = "cell int, sums array<double>"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a batch, all of length ``dim``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), dim)


def cell_sums(sums: np.ndarray) -> pa.RecordBatch:
    """A partition's (cells, width) sums as rows."""
    cells = pa.array(np.arange(len(sums), dtype=np.int32))
    offsets = pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32))
    return pa.RecordBatch.from_arrays([cells, pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], ["cell", "sums"])


def few_parts(rows: DataFrame, cells: int, width: int) -> bool:
    """Whether the driver may hold the sums of every partition at once."""
    return rows.rdd.getNumPartitions() * cells * width * 8 <= SMALL_BYTES


def added(parts: DataFrame, cells: int, width: int, few: bool) -> np.ndarray:
    """(cells, width): the sums of all partitions, added by the driver if they are ``few``, else in Spark."""
    out = np.zeros((cells, width))
    if few:
        found = parts.toArrow().combine_chunks()
        if found.num_rows:
            np.add.at(out, found.column("cell").to_numpy(), matrix(found.column("sums").combine_chunks(), width))
    else:
        for row in vector_sums(parts, ["cell"], "sums", dim=width).collect():
            out[row.cell] = row.sums
    return out
