"""Vectors of a table as blocks of numbers: which ones count, exact copies folded, products in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbers(df: DataFrame, column: str) -> Column:
    """A vector column as it is if it holds floats or doubles, else as doubles."""
    kind = df.schema[column].dataType.simpleString()
    return F.col(column) if kind == "array<float>" else F.col(column).cast("array<double>")


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, only finite components, not all zero."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    """A list column of vectors of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, length)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by their largest component, so nothing overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
