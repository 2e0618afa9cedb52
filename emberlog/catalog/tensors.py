"""Tensor queries over the events log and the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.catalog.dense import vectors
from emberlog.catalog.kv import _LOG, event_log
from emberlog.operators import tensor as X
from emberlog.sources.tables import table


def _named(spark, d):
    return vectors(spark, d).select(F.concat(F.lit("vec/"), F.lpad(F.col("key").cast("string"), 8, "0")).alias("name"), F.col("vector").alias("data"))


def tensor_elements(spark, d):
    return X.elements(event_log(spark, d), "user/1*").select("key", "value")


def tensor_history(spark, d):
    return X.elements(event_log(spark, d), "user/7/*", mode="history")


def tensor_int32(spark, d):
    return X.elements(event_log(spark, d), "user/2*", "int32").select("key", "value")


def tensor_assemble(spark, d):
    t = X.assemble(X.elements(event_log(spark, d), "user/3*"))
    return t.select("n", F.element_at("data", 1).alias("first"), F.element_at("data", -1).alias("last"), F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def tensor_put(spark, d):
    return X.put_elements(_named(spark, d)).select("key", F.round(F.col("value").cast("double"), 6).alias("value"))


def tensor_chunks(spark, d):
    chunks, _ = X.to_chunks(_named(spark, d), size=100)
    return chunks.select("name", "chunk_id", F.octet_length("data").alias("bytes"))


def tensor_deleted(spark, d):
    """Chunks left after the tensors whose name ends in 0 were deleted."""
    chunks, meta = X.to_chunks(_named(spark, d), size=100)
    chunks, meta = X.delete_chunked(chunks, meta, meta.select("name").filter(F.col("name").endswith("0")))
    return chunks.join(meta.select("name"), "name").groupBy("name").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("data")).alias("bytes"))


def tensor_meta(spark, d):
    _, meta = X.to_chunks(_named(spark, d), "float64", size=100)
    return meta.select("name", F.element_at("shape", 1).alias("n"), "dtype", "total_bytes", "chunk_count")


def tensor_roundtrip(spark, d):
    chunks, meta = X.to_chunks(_named(spark, d), size=100)
    return X.from_chunks(chunks, meta).select("name", F.posexplode("data").alias("pos", "x")).select("name", "pos", F.round("x", 6).alias("x"))


def tensor_batches(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("key"), "value")
    return X.batches(e, 64).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.round(F.sum("value"), 4).alias("total"))


def tensor_shuffled_batches(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("key"), "value")
    return X.batches(e, 64, shuffle_seed=3, drop_last=True).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


def train_test_split(spark, d):
    return X.split(table(spark, d, "events").select(F.col("event_id").alias("key"))).select("key", "part")


def train_test_hashed(spark, d):
    return X.split(table(spark, d, "events").select(F.col("event_id").alias("key")), seed=1).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def train_test_hashed_held(spark, d):
    """One row: how many rows are dealt out, and whether between 0.78 and 0.82 of them are for training."""
    parts = X.split(table(spark, d, "events").select(F.col("event_id").alias("key")), seed=1)
    return parts.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("part") == "train").cast("double")).between(0.78, 0.82).alias("share_held"))


def tensor_shards(spark, d):
    return X.shards(table(spark, d, "events").select(F.col("event_id").alias("key")), 3).select("key", "shard")


def tensor_transform(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return X.map_samples(e, lambda f: f.assign(value=f["value"] * 2 + 1), "event_id bigint, value double")


QUERIES = {k: f for k, f in globals().items() if k.startswith(("tensor_", "train_")) and callable(f)}

_E = _LOG + ", x AS (SELECT key, coalesce(f, i::DOUBLE) AS value FROM latest WHERE tag IN ('float', 'int'))\n"
_N = "WITH v AS (SELECT 'vec/' || lpad(vec_id::VARCHAR, 8, '0') AS name, embedding AS data FROM embeddings)\n"
ORACLE = {
    "train_test_hashed_held": "SELECT count(*) AS rows, true AS share_held FROM events",
    "tensor_elements": _E + "SELECT key, value FROM x WHERE starts_with(key, 'user/1')",
    "tensor_history": _LOG + "SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS pos, f AS value FROM log WHERE op <> 'D' AND tag = 'float' AND starts_with(key, 'user/7/')",
    "tensor_int32": _E + "SELECT key, trunc(value)::INT AS value FROM x WHERE starts_with(key, 'user/2')",
    "tensor_assemble": _E + "SELECT count(*) AS n, arg_min(value, key) AS first, arg_max(value, key) AS last, round(sum(value), 4) AS total FROM x WHERE starts_with(key, 'user/3')",
    "tensor_put": _N + "SELECT name || '/' || lpad((i - 1)::VARCHAR, 8, '0') AS key, round(e::DOUBLE, 6) AS value FROM (SELECT name, unnest(data) AS e, unnest(range(1, 65)) AS i FROM v)",
    "tensor_chunks": _N + "SELECT name, c AS chunk_id, least(100, 256 - c * 100) AS bytes FROM v, (SELECT unnest(range(0, 3)) AS c)",
    "tensor_deleted": _N + "SELECT name, 3::BIGINT AS chunks, 256::BIGINT AS bytes FROM v WHERE NOT ends_with(name, '0')",
    "tensor_meta": _N + "SELECT name, len(data) AS n, 'float64' AS dtype, len(data) * 8 AS total_bytes, 6 AS chunk_count FROM v",
    "tensor_roundtrip": _N + "SELECT name, i AS pos, round(e::DOUBLE, 6) AS x FROM (SELECT name, unnest(data) AS e, unnest(range(0, 64)) AS i FROM v)",
    "tensor_batches": "SELECT b AS batch, count(*) AS n, min(event_id) AS first, round(sum(value), 4) AS total FROM (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS b FROM events) GROUP BY b",
    "tensor_shuffled_batches": "SELECT unnest(range(0, (SELECT count(*) FROM events) // 64)) AS batch, 64 AS n",
    "train_test_split": "SELECT event_id AS key, CASE WHEN row_number() OVER (ORDER BY event_id) - 1 < floor((SELECT count(*) FROM events) * 0.8) THEN 'train' ELSE 'test' END AS part FROM events",
    "tensor_shards": "SELECT event_id AS key, (row_number() OVER (ORDER BY event_id) - 1) % 3 AS shard FROM events",
    "tensor_transform": "SELECT event_id, value * 2 + 1 AS value FROM events",
}
