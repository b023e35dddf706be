"""Vector columns as integer matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column | str) -> Column:
    """True where a vector is there and none of its entries is null, infinite or not a number."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    entry = lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))  # noqa: E731  not a number sorts above infinity
    return F.coalesce(F.forall(vector.cast("array<double>"), entry), F.lit(False))


def width_of(rows: DataFrame, vector: str) -> tuple[int, int]:
    """(rows, entries of the longest vector)."""
    seen = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    return seen[0], max(seen[1], 0)


def scaled(column: pa.Array, width: int, scale: int, most: int) -> np.ndarray:
    """floor(scale * entry) of each row as int64, held within +-``most``; rows too short end in zeros."""
    out = np.zeros((len(column), width))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(column)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        out[row, place] = np.clip(np.floor(scale * values), -most, most)
    return out.astype(np.int64)
