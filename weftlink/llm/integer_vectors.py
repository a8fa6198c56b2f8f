"""Vectors as whole numbers: exact squared distances in 64 bits, whatever the order of their sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a squared distance may come to at most.
MOST = 1 << 62


def finite(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component; zeros and no components at all are fine."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(df: DataFrame, key: str, vector: str, scale: int, *more: str) -> DataFrame:
    """(id, x array<long>) of the rows with a finite vector: floor(scale * component). ``more`` are columns to carry."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v"), *more).where(finite(F.col("v")))
    return rows.select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("x"), *more)


def check_range(vectors: DataFrame, dims: int) -> int:
    """Number of ``vectors``; an error where components are so large that a squared distance needs over 64 bits."""
    # -1 - x instead of -x: the smallest 64-bit number has no opposite.
    n, most = vectors.agg(F.count(F.lit(1)), F.max(F.greatest(F.array_max("x"), -1 - F.array_min("x")))).first()
    if most is not None and dims * (2 * (int(most) + 1)) ** 2 >= MOST:
        raise ValueError(f"components of up to {most} after scaling: squared distances do not fit 64 bits")
    return n


def block(column: pa.Array, dims: int) -> np.ndarray:
    """A column of arrays of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)


def floor_means(sums: list[int], n: int) -> list[int]:
    """Exact floor(sum / n) of each."""
    return [int(s) // int(n) for s in sums]
