"""Vectors as whole numbers: which take part, their matrices in tasks, and exact inner products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A vector of whole numbers takes part if the sum of its squares is at most this. Then no inner product of two of them
#: leaves a long, whatever their signs, as |a.b| <= |a| |b|.
LARGEST = 9.0e18


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds no null and no component that is not finite."""
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def quantized(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double.

    Null for a vector that is null, holds a null or a component that is not finite, or is so large that the sum of its
    squares would not be a long (`LARGEST`); such a vector takes no part.
    """
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    small = F.aggregate(whole, F.lit(0.0), lambda s, x: s + x * x) <= LARGEST
    return F.when(finite(vector) & small, whole)


def main_length(rows: DataFrame, vector: str) -> tuple[int, int]:
    """The length of most vectors (of equally frequent ones the longest), and how many have it; (0, 0) without any."""
    first = rows.groupBy(F.size(vector).alias("length")).count().where("length > 0").orderBy(F.desc("count"), F.desc("length")).first()
    return (first["length"], first["count"]) if first else (0, 0)


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two matrices of whole numbers, as longs.

    Where floating point could round, the product is taken in 64-bit integers: partial sums may wrap around, but the
    whole, which is a long (`LARGEST`), comes out exactly.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
