"""Arithmetic on array columns, accumulated in double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def width_of(vectors: pa.ListArray) -> int:
    """Length of the first vector."""
    return len(vectors[0]) if len(vectors) else 0


def rows_of(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Matrix with a vector in each row; a missing element is zero, a missing vector or another length an error."""
    if vectors.null_count:
        raise ValueError("a vector is missing")
    if not np.array_equal(vectors.value_lengths().to_numpy(zero_copy_only=False), np.full(len(vectors), width)):
        raise ValueError(f"the vectors do not all have {width} elements")
    return vectors.flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def scale(v: Column, k) -> Column:
    return F.transform(doubles(v), lambda x: x * k)


def unit(v: Column) -> Column:
    """Length one; an all-zero vector stays as it is."""
    return F.transform(
        F.arrays_zip(doubles(v).alias("x"), F.array_repeat(norm(v), F.size(v)).alias("n")),
        lambda p: F.when(p["n"] > 0, p["x"] / p["n"]).otherwise(p["x"]),
    )


def zeros(size: int) -> Column:
    return F.array_repeat(F.lit(0.0), size)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    parts = F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + p)
