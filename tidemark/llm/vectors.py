"""What the embedding operators share: which vectors take part, and packing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def takes_part(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components. False also for an empty vector."""
    d = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(d(x)) & (F.abs(d(x)) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: d(x) != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    return np.array(column.tolist(), np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows are scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
