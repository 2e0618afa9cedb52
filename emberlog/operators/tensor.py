"""Tensors over the log: elements by key pattern, chunks of bytes with a description, batches, splits and shards."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.atoms import as_double
from emberlog.functions.patterns import indexed_key, key_matches
from emberlog.operators.log import float_history, latest
from emberlog.operators.numbering import number_rows

# NumPy names of the tensor types, little endian.
DTYPES = {"float32": "<f4", "float64": "<f8", "int32": "<i4", "int64": "<i8"}


def chunk_size(total_bytes: int) -> int:
    """1 MiB up to 10 MB, 4 MiB up to 100 MB, then 16 MiB."""
    return 2**20 if total_bytes <= 10 * 2**20 else 4 * 2**20 if total_bytes <= 100 * 2**20 else 16 * 2**20


def chunk_size_column(total: Column) -> Column:
    return F.when(total <= 10 * 2**20, 2**20).when(total <= 100 * 2**20, 4 * 2**20).otherwise(16 * 2**20)


def elements(log: DataFrame, pattern: str, dtype: str = "float64", mode: str = "latest", dialect: str = "prefix") -> DataFrame:
    """key, pos, value of the keys that match, in key order: the latest value each, or (mode 'history') every float ever put.

    Values without a number (null, text, bytes) are skipped.
    """
    match = key_matches(F.col("key"), pattern, dialect)
    if mode == "history":
        rows = float_history(log.filter(match)).select("key", "pos", F.col("f").alias("value"))
    else:
        rows = latest(log.filter(match)).select("key", F.lit(0).cast("bigint").alias("pos"), as_double(dtype).alias("value"))
    return rows.filter("value is not null")


def assemble(rows: DataFrame, most: int = 50_000_000) -> DataFrame:
    """n, data: one tensor of all elements in (key, pos) order, in one row; more than ``most`` elements are refused (those stay chunked)."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} elements: read them in chunks")
    ordered = F.sort_array(F.collect_list(F.struct("key", "pos", "value")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.transform(ordered, lambda x: x["value"]).alias("data"))


def put_elements(arrays: DataFrame, name: str = "name", data: str = "data") -> DataFrame:
    """key, value: one row per element, keys zero padded to eight digits."""
    cells = arrays.select(name, F.posexplode(data).alias("i", "value"))
    return cells.select(F.concat(F.col(name), indexed_key("/", F.col("i"))).alias("key"), "value")


def to_chunks(arrays: DataFrame, dtype: str = "float32", size: int | None = None, name: str = "name", data: str = "data", shape: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks: name, chunk_id, data BINARY; meta: name, shape, dtype, total_bytes, chunk_size, chunk_count)."""
    kind = np.dtype(DTYPES[dtype])

    @F.pandas_udf("binary")
    def raw(values: pd.Series) -> pd.Series:
        return values.map(lambda v: np.asarray(v, kind).tobytes())

    shaped = F.col(shape) if shape else F.array(F.size(data).cast("bigint"))
    blobs = arrays.select(name, shaped.alias("shape"), raw(F.col(data)).alias("raw")).withColumn("total_bytes", F.octet_length("raw").cast("bigint"))
    blobs = blobs.withColumn("chunk_size", F.lit(size) if size else chunk_size_column(F.col("total_bytes")))
    count = F.greatest(F.lit(1), F.ceil(F.col("total_bytes") / F.col("chunk_size"))).cast("int")
    meta = blobs.select(name, "shape", F.lit(dtype).alias("dtype"), "total_bytes", "chunk_size", count.alias("chunk_count"))
    chunks = blobs.select(name, "raw", "chunk_size", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_id"))
    part = F.substring(F.col("raw"), (F.col("chunk_id") * F.col("chunk_size") + 1).cast("int"), F.col("chunk_size").cast("int"))
    return chunks.select(name, "chunk_id", part.alias("data")), meta


def delete_chunked(chunks: DataFrame, meta: DataFrame, names: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Chunks and meta without the named tensors (a column ``name``); an unknown name deletes nothing."""
    gone = names.select(name).distinct()
    return chunks.join(gone, name, "left_anti"), meta.join(gone, name, "left_anti")


def from_chunks(chunks: DataFrame, meta: DataFrame, name: str = "name") -> DataFrame:
    """name, shape, dtype, data ARRAY<DOUBLE>; missing bytes fail the job."""
    whole = chunks.groupBy(name).agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "data"))), lambda c: c["data"]).alias("parts"))
    raw = F.aggregate("parts", F.unhex(F.lit("")), lambda a, p: F.concat(a, p))
    joined = whole.withColumn("raw", raw).join(meta, name)
    message = F.concat(F.lit("incomplete tensor: "), F.col(name))
    checked = joined.withColumn("raw", F.when(F.octet_length("raw") == F.col("total_bytes"), F.col("raw")).otherwise(F.raise_error(message)))

    @F.pandas_udf("array<double>")
    def decode(raws: pd.Series, dtypes: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(r, DTYPES[d]).astype(np.float64) for r, d in zip(raws, dtypes)])

    return checked.select(name, "shape", "dtype", decode("raw", "dtype").alias("data"))


def pack_blob(values: np.ndarray, dtype: str = "float32") -> bytes:
    """A tensor as one value: length of the description (u32), the description in JSON, the elements' bytes."""
    meta = json.dumps({"shape": list(values.shape), "dtype": dtype}).encode()
    return len(meta).to_bytes(4, "little") + meta + np.ascontiguousarray(values, DTYPES[dtype]).tobytes()


def unpack_blob(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    meta = json.loads(data[4 : 4 + n])
    return np.frombuffer(data[4 + n :], DTYPES[meta["dtype"]]).reshape(meta["shape"])


def reshape_ok(n: Column, shape: Column) -> Column:
    """Does the shape hold exactly n elements?"""
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, x: a * x) == n


def batches(rows: DataFrame, size: int, order: str = "key", shuffle_seed: int | None = None, drop_last: bool = False) -> DataFrame:
    """Adds ``batch`` and ``place``; the last batch may be short (or be dropped). With a seed: in a shuffled order.

    Numbers are dense over all rows, found by range partition and offset, so no task holds more than its partition.
    """
    key = F.xxhash64(F.lit(shuffle_seed), F.col(order)) if shuffle_seed is not None else F.col(order)
    numbered = number_rows(rows.withColumn("__k", key), ["__k", order], "__n")
    out = numbered.withColumns({"batch": F.floor(F.col("__n") / size), "place": (F.col("__n") % size).cast("int")})
    if drop_last:
        full = out.groupBy("batch").agg(F.count(F.lit(1)).alias("__full")).filter(F.col("__full") == size).select("batch")
        out = out.join(full, "batch", "left_semi")
    return out.drop("__k", "__n")


def split(rows: DataFrame, share: float = 0.8, order: str = "key", seed: int | None = None) -> DataFrame:
    """Adds ``part`` 'train' or 'test': the first share of the rows in order, or (with a seed) by the hash of the key."""
    if seed is not None:
        return rows.withColumn("part", F.when(F.pmod(F.xxhash64(F.lit(seed), F.col(order)), F.lit(10_000)) < int(share * 10_000), "train").otherwise("test"))
    numbered = number_rows(rows, [order], "__n")
    total = rows.agg(F.count(F.lit(1))).scalar()
    return numbered.withColumn("part", F.when(F.col("__n") < F.floor(total * share), "train").otherwise("test")).drop("__n")


def shards(rows: DataFrame, replicas: int, order: str = "key") -> DataFrame:
    """Adds ``shard`` 0..replicas-1: every row in one shard, sizes differing by at most one."""
    return number_rows(rows, [order], "__n").withColumn("shard", (F.col("__n") % replicas).cast("int")).drop("__n")


def map_samples(rows: DataFrame, transform: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Applies a caller's function to batches of rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield transform(f)

    return rows.mapInPandas(run, schema)


def embed(docs: DataFrame, embedder: Callable[[list[str]], list[list[float]]], id: str = "id", text: str = "content") -> DataFrame:
    """id, vector of every text by a caller's embedder, batch by batch; null texts are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({id: f[id], "vector": embedder(f[text].tolist())})

    kind = dict(docs.dtypes)[id]
    return docs.select(id, text).filter(F.col(text).isNotNull()).mapInPandas(run, f"{id} {kind}, vector array<float>")
