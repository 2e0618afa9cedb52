"""Feeding rows to a training loop on the driver: batch by batch, shard by shard, never all at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.tensor import batches, shards


def iterate(rows: DataFrame, size: int, order: str = "key", shuffle_seed: int | None = None, drop_last: bool = False, columns: list[str] | None = None, transform: Callable | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Batches as columns of arrays, in key order or shuffled; partitions are fetched one after the other.

    drop_last leaves out a short last batch (fixed shapes); ``transform`` is applied to each batch.
    """
    numbered = batches(rows, size, order, shuffle_seed, drop_last)
    wanted = columns or rows.columns
    held: list = []
    for row in numbered.orderBy("batch", "place").select(*wanted).toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield _batch(held, wanted, transform)
            held = []
    if held:
        yield _batch(held, wanted, transform)


def _batch(rows: list, columns: list[str], transform: Callable | None):
    out = {c: np.array([r[c] for r in rows]) for c in columns}
    return transform(out) if transform else out


def replica(rows: DataFrame, replicas: int, rank: int, order: str = "key") -> DataFrame:
    """The rows of one of several replicas: disjoint, together everything."""
    if not 0 <= rank < replicas:
        raise ValueError(f"rank {rank} of {replicas}")
    return shards(rows, replicas, order).filter(F.col("shard") == rank).drop("shard")


def samples(log: DataFrame) -> DataFrame:
    """key, x of every live key as a sample: all its floats in order, else its number, else [0.0]."""
    from emberlog.functions.atoms import as_double
    from emberlog.operators.log import float_history, latest

    floats = float_history(log).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "f"))), lambda p: p["f"]).alias("series"))
    last = latest(log).select("key", as_double().alias("value"))
    return last.join(floats, "key", "left").select("key", F.coalesce("series", F.when(F.col("value").isNotNull(), F.array("value")), F.array(F.lit(0.0))).alias("x"))


def paired(features: DataFrame, labels: DataFrame, on: str = "i") -> DataFrame:
    """A labelled dataset from two typed tables with one running number."""
    return features.join(labels, on)
