"""Vectors as exact integers: quantised components, packed blocks, products and distances without rounding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer components stay below this in absolute value, so that sums of products fit a signed 64-bit integer.
LIMIT = 1 << 23
#: Integers up to this are exact in double precision, where products are fastest.
_EXACT = 1 << 53


def finite(v: Column) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    return F.coalesce(F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def floored(v: Column, factor: int) -> Column:
    """array<int> of floor(factor * x) for each component x as a double; a component beyond ``LIMIT`` fails the job."""

    def whole(x: Column) -> Column:
        y = F.floor(F.lit(float(factor)) * x.cast("double"))
        return F.when(F.abs(y) < LIMIT, y).otherwise(F.raise_error(F.lit(f"a component times {factor} exceeds {LIMIT}"))).cast("int")

    return F.transform(v, whole)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of integer arrays of one length as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int32).reshape(len(column), dims)


def unpacked(data: bytes, dims: int) -> np.ndarray:
    """A matrix of packed 32-bit integers."""
    x = np.frombuffer(data, dtype="<i4")
    return x.reshape(-1, dims) if dims else np.zeros((0, 0), dtype=np.int32)


def _bound(a: np.ndarray, b: np.ndarray) -> int:
    return int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) exact inner products, as 64-bit integers."""
    if _bound(a, b) < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(len(x), len(centres)) exact squared Euclidean distances, as 64-bit integers."""
    x, centres = x.astype(np.int64), centres.astype(np.int64)
    return (x * x).sum(axis=1)[:, None] - 2 * products(x, centres) + (centres * centres).sum(axis=1)
