"""Reading array columns of vectors into matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True where a vector is not null or empty and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def matrix(column, width: int) -> np.ndarray:
    """Rows of a column of arrays as doubles, short ones filled with zeros."""
    out = np.zeros((len(column), width))
    lengths = np.fromiter((len(x) for x in column), np.int64, len(column))
    if len(column) and (lengths == width).all():
        return np.stack(column.to_numpy()).astype(np.float64)
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out
