"""Distances of dense vectors as column expressions (double arithmetic) and as a NumPy kernel for batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric codes; any other code means cosine.
METRICS = {0: "cosine", 1: "euclidean", 2: "dot"}
TINY = 1e-10


def metric_of(code: int | str) -> str:
    if isinstance(code, str):
        if code not in METRICS.values():
            raise ValueError(f"no such metric: {code}")
        return code
    return METRICS.get(code, "cosine")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(squared_norm(a))


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; 1 where the product of the lengths is below 1e-10."""
    length = F.sqrt(squared_norm(a) * squared_norm(b))
    return F.when(length < TINY, F.lit(1.0)).otherwise(1.0 - dot(a, b) / length)


def euclidean(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def distance(metric: str, a: Column, b: Column) -> Column:
    """Lower is closer; dot is the negative product."""
    return {"cosine": cosine, "euclidean": euclidean, "dot": lambda x, y: -dot(x, y)}[metric_of(metric)](a, b)


def similarity(score: Column) -> Column:
    return 1.0 - score


def normalised(a: Column) -> Column:
    """The vector divided by its length; a vector shorter than 1e-10 stays as it is."""
    n = norm(a)
    return F.when(n < TINY, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def distance_matrix(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of the rows of q to the rows of x, as matrix products."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    p = q @ x.T
    if metric == "dot":
        return -p
    qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
    if metric == "euclidean":
        return np.sqrt(np.maximum(qq[:, None] + xx[None, :] - 2 * p, 0.0))
    length = np.sqrt(qq[:, None] * xx[None, :])
    return np.where(length < TINY, 1.0, 1.0 - p / np.where(length < TINY, 1.0, length))
