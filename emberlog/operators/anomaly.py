"""Anomalies of a series by reconstruction: how badly the last values fit what a linear autoencoder keeps of them.

A window is the last ``window`` normalised values of a key, in order. The autoencoder is linear: its code is the projection on the leading
principal components of all windows, which no linear code of that size beats. A window's score is its mean squared reconstruction error, and
scores above the threshold (a quantile of the fitted windows' scores) are anomalies. ``streaming.streams.anomalies`` runs the same model live.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.series import lags


@dataclass(frozen=True)
class WindowModel:
    """mean and std of the values, orthonormal components of the windows, and the greatest score that is no anomaly."""

    window: int
    mean: float
    std: float
    components: tuple[tuple[float, ...], ...]
    threshold: float = math.inf

    def normal(self, value: Column) -> Column:
        return (value - self.mean) / (self.std + 1e-8)

    def score(self, values: Column) -> Column:
        """Mean squared error of an array of ``window`` normalised values: what the components don't hold of its length."""
        left = F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)
        for c in self.components:
            along = F.aggregate(F.zip_with(values, F.lit(list(c)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
            left = left - along * along
        return F.greatest(left / self.window, F.lit(0.0))


def level_model(series: DataFrame, window: int, value: str = "f") -> WindowModel:
    """The model whose only component is a window's level: its scores are the windows' variances."""
    mean, std = series.agg(F.avg(value), F.stddev_pop(value)).first()
    return WindowModel(window, mean or 0.0, std or 0.0, (tuple([1 / math.sqrt(window)] * window),))


def windows(series: DataFrame, model: WindowModel, key: str = "key", order: str = "seq", value: str = "f", chunk: int | None = None) -> DataFrame:
    """key, order, values: the last normalised values at every row that has ``window`` of them. Null values are passed over."""
    z = series.filter(F.col(value).isNotNull()).select(key, order, model.normal(F.col(value)).alias("f")).withColumnRenamed(key, "key").withColumnRenamed(order, "seq")
    n = model.window
    before = lags(z, list(range(1, n)), chunk=chunk) if n > 1 else z
    values = F.array(*[F.col(f"lag_{i}") for i in range(n - 1, 0, -1)], F.col("f"))
    full = before if n == 1 else before.filter(F.col(f"lag_{n - 1}").isNotNull())
    return full.select(F.col("key").alias(key), F.col("seq").alias(order), values.alias("values"))


def scores(series: DataFrame, model: WindowModel, key: str = "key", order: str = "seq", value: str = "f", chunk: int | None = None) -> DataFrame:
    """key, order, score, anomaly."""
    s = windows(series, model, key, order, value, chunk).select(key, order, model.score(F.col("values")).alias("score"))
    return s.withColumn("anomaly", F.col("score") > model.threshold)


def fit(series: DataFrame, window: int = 16, components: int = 4, quantile: float = 0.99, key: str = "key", order: str = "seq", value: str = "f") -> WindowModel:
    """The model of all windows of a series, its threshold at a quantile of their scores."""
    flat = level_model(series, window, value)
    w = windows(series, flat, key, order, value)
    rows = w.select(array_to_vector("values").alias("x"))
    if rows.isEmpty():
        return flat
    pc = PCA(k=min(components, window), inputCol="x", outputCol="p").fit(rows).pc.toArray()
    model = WindowModel(window, flat.mean, flat.std, tuple(tuple(float(x) for x in c) for c in pc.T))
    limit = w.select(model.score(F.col("values")).alias("score")).agg(F.percentile_approx("score", quantile, 10_000)).first()[0]
    return WindowModel(window, model.mean, model.std, model.components, limit)
