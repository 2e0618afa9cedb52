"""Fixed-size uniform sample of distinct records whose number is not known in advance.

The distinct records are numbered densely, 0..N-1: by bucket of their hash, and in a bucket by hash and content, with the
bucket sizes' running sum as offsets. A seeded Feistel network with cycle walking permutes 0..N-1, and the records whose
new position is below k are the sample. The numbers depend on content alone, not on piece, order, id or partitioning, so a
task that is run again numbers alike, and a copy changes nothing.

Defined results
    * records are equal if all key columns are: nulls equal nulls, NaN equals NaN, 0.0 equals -0.0; an empty array is not null.
    * of equal records the one with the least ``id`` (nulls last) is given; ``position`` 0..min(k, N)-1 is unique.
    * fewer than k distinct records: all of them. Empty input: empty. k <= 0: empty.
    * columns besides keys and id are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.plans.session import cut

ROUNDS = 8
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor) as round function."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key & int(_M))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x


def feistel(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The seeded permutation of 0..n-1: a balanced Feistel network on the next even power of two, cycle walking into the range."""
    half = np.uint64(max(1, math.ceil(max(n - 1, 1).bit_length() / 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [int(k) for k in np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, ROUNDS)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        return (left << half) | right

    out = once(x.astype(np.uint64))
    away = np.flatnonzero(out >= np.uint64(n))
    while len(away):
        out[away] = once(out[away])
        away = away[out[away] >= np.uint64(n)]
    return out.astype(np.int64)


def uniform_sample(records: DataFrame, keys: list[str], k: int, *, id: str | None = None, seed: int = 0, bucket_rows: int = 50_000) -> DataFrame:
    """k distinct records of ``records``, every one with the same chance: position, keys (and the least id).

    The buckets of the dense numbering hold about ``bucket_rows`` records, however many there are; with the seed it fixes the sample.
    """
    picked = records.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keys)], (F.col(id) if id else F.lit(None).cast("bigint")).alias("id"))
    cols = [f"c{i}" for i in range(len(keys))]
    distinct = cut(picked.groupBy(*cols).agg(F.min("id").alias("id")).withColumn("h", F.xxhash64(*cols)))  # combined on the map side: copies never meet in one task
    total = distinct.count()
    distinct = distinct.withColumn("bucket", F.pmod("h", F.lit(max(1, -(-total // bucket_rows)))))
    sizes = distinct.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a bucket
    in_bucket = Window.partitionBy("bucket").orderBy("h", *cols)
    numbered = distinct.withColumn("place", F.row_number().over(in_bucket)).join(sizes.select("bucket", before.alias("offset")), "bucket")

    @F.pandas_udf("bigint")
    def permuted(x: pd.Series) -> pd.Series:
        return pd.Series(feistel(x.to_numpy(), total, seed))

    return (
        numbered.withColumn("position", permuted((F.col("offset") + F.col("place") - 1).cast("bigint")))
        .filter(F.col("position") < k)
        .select("position", *[F.col(f"c{i}").alias(c) for i, c in enumerate(keys)], *([F.col("id").alias(id)] if id else []))
    )
