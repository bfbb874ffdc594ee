"""Vectors of Arrow batches as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers up to here are exact in float64; sums of products below it come out of BLAS exactly.
EXACT = 2**53
LONG = 2**63


def sound(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def matrices(lists: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, float64 matrix) of the vectors of ``d`` finite components."""
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == d)
    flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    x = np.asarray(flat, np.float64).reshape(len(at), d)
    fine = np.isfinite(x).all(axis=1)
    return at[fine], x[fine]


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as float64 (whole numbers, not yet exact beyond 2**53 but true to the product)."""
    return np.floor(x * scale)


def big(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers, for components of any size."""
    return np.array([[int(v) * scale if abs(v) >= EXACT else int(np.floor(v * scale)) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
