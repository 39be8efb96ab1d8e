"""Vectors of whole numbers, for the operators that must be exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector isn't null and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)), F.lit(False))


def kept(df: DataFrame, vector: str, **columns: Column) -> tuple[DataFrame, int]:
    """The named columns and v, the finite vectors in double precision, and their size.

    Vectors of another size than the most frequent (of equally frequent ones, the
    largest) can't be compared with the rest and take no part; size 0: there are none.
    """
    rows = df.select(*(c.alias(n) for n, c in columns.items()), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(finite(F.col("v")) & (F.size("v") > 0))
    sizes = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).first()
    size = sizes["s"] if sizes else 0
    return rows.where(F.size("v") == size), size


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """An Arrow column of vectors of one size as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def floored(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; components beyond them are an error."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * x)
    if out.size and np.abs(out).max() >= 2.0**63:
        raise ValueError(f"a component times {scale} doesn't fit into 64 bits")
    return out.astype(np.int64)


def exact(x: np.ndarray, bound: int) -> np.ndarray:
    """The numbers themselves where ``bound`` fits into 64 bits, else Python's of any size."""
    return x if bound < 1 << 63 else x.astype(object)


def largest(x: np.ndarray) -> int:
    """The largest absolute value."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def longs(x: np.ndarray) -> np.ndarray:
    """As 64-bit integers; numbers beyond them are an error."""
    if x.dtype == object and largest(x) >= 1 << 63:
        raise ValueError("a sum of products doesn't fit into 64 bits")
    return x.astype(np.int64)
