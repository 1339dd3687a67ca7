"""Vector columns: the rows that can be used, and Arrow lists as number grids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_rows(rows: DataFrame, vector: str, *keep: str) -> DataFrame:
    """The kept columns and the vector as doubles; without vectors that are null or hold null or non-finite entries."""
    v = F.col(vector).cast("array<double>")
    usable = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(*keep, v.alias("_vector")).where(F.col("_vector").isNotNull() & usable)


def width_of(rows: DataFrame) -> int:
    """Entries of the longest vector, 0 without rows."""
    return rows.agg(F.max(F.size("_vector"))).first()[0] or 0


def grid(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows x width doubles; a shorter vector is followed by zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    offsets = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    at = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    out[np.repeat(np.arange(len(column)), sizes), at] = flat
    return out


def scaled(values: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) as integers; larger ones than ``most`` are an error, as sums of them would not be exact."""
    scaled = np.floor(values * scale)
    if scaled.size and np.abs(scaled).max() > most:
        raise ValueError(f"an entry beyond {most // scale} in size has no exact integer here")
    return scaled.astype(np.int64)
