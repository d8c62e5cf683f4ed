"""Vector expressions and kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MixedDimensionsError(ValueError):
    """Vectors of one table differ in length."""


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def as_float(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("float"))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def within(dist: Column, threshold: float, compat_f32: bool = False) -> Column:
    """dist <= threshold, never true for NaN; with compat_f32 both sides are compared as 32-bit floats."""
    if compat_f32:
        return (dist.cast("float") <= F.lit(threshold).cast("float")) & ~F.isnan(dist)
    return (dist <= F.lit(float(threshold))) & ~F.isnan(dist)


def shape(df: DataFrame, v: str = "v") -> DataFrame:
    """One row: n, dim, bytes of 32-bit floats, and n_dims, the number of different lengths."""
    return df.agg(F.count("*").alias("n"), F.max(F.size(v)).cast("long").alias("dim"), F.count_distinct(F.size(v)).alias("n_dims")).withColumn("bytes", 4 * F.col("n") * F.col("dim"))


def check_dimensions(df: DataFrame, v: str = "v") -> int:
    row = shape(df, v).first()
    if row.n_dims > 1:
        raise MixedDimensionsError(f"{row.n_dims} different lengths")
    return row.dim or 0


def euclidean(a, b) -> np.ndarray:
    """Distances of each row of a to each row of b; single vectors count as one row."""
    x, y = np.atleast_2d(np.asarray(a, float)), np.atleast_2d(np.asarray(b, float))
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float, f32: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in a and b within the threshold, and the distances. A product of matrices picks candidates with some slack;
    their distances are worked out again from the differences, because the product form cancels near 0."""
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    with np.errstate(invalid="ignore", over="ignore"):
        squared = na[:, None] + nb[None, :] - 2 * (a @ b.T)
        slack = 1e-9 * (na[:, None] + nb[None, :]) + 1e-9
        i, j = np.nonzero(squared <= (threshold * (1 + 1e-6)) ** 2 + slack)
        d = a[i] - b[j]
        dist = np.sqrt(np.einsum("nd,nd->n", d, d))
        keep = dist.astype(np.float32) <= np.float32(threshold) if f32 else dist <= threshold
    return i[keep], j[keep], dist[keep]
