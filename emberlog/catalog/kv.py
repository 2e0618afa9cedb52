"""Key/value queries over a log made of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.atoms import as_double, printable
from emberlog.functions.patterns import segment
from emberlog.operators import log as L
from emberlog.sources.tables import table


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: key user/<id>/<type>, every 17th row a tombstone, values of all tags by event_id."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id") % 11
    put = F.col("event_id") % 17 != 0
    tag = F.when(~put | (n == 10), "null").when(n == 7, "int").when(n == 8, "text").when(n == 9, "bytes").otherwise("float")
    base = e.select(F.col("event_id").alias("seq"), "ts", F.concat(F.lit("user/"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("key"), F.when(put, "P").otherwise("D").alias("op"), tag.alias("tag"), "value")
    return base.select(
        "seq", "ts", "key", "op", "tag", F.when(F.col("tag") == "float", F.col("value")).alias("f"), F.when(F.col("tag") == "int", F.floor("value")).alias("i"), F.when(F.col("tag") == "text", F.concat(F.lit("v"), F.floor("value").cast("string"))).alias("s"),
        F.when(F.col("tag") == "bytes", F.encode(F.floor("value").cast("string"), "utf-8")).alias("b"), F.lit(None).cast("array<float>").alias("v"),
    )


_LOG = """
WITH base AS (SELECT event_id AS seq, ts, 'user/' || user_id || '/' || event_type AS key, CASE WHEN event_id % 17 <> 0 THEN 'P' ELSE 'D' END AS op,
  CASE WHEN event_id % 17 = 0 OR event_id % 11 = 10 THEN 'null' WHEN event_id % 11 = 7 THEN 'int' WHEN event_id % 11 = 8 THEN 'text' WHEN event_id % 11 = 9 THEN 'bytes' ELSE 'float' END AS tag, value FROM events),
log AS (SELECT seq, ts, key, op, tag, CASE WHEN tag = 'float' THEN value END AS f, CASE WHEN tag = 'int' THEN floor(value)::BIGINT END AS i,
  CASE WHEN tag = 'text' THEN 'v' || floor(value)::BIGINT END AS s, CASE WHEN tag = 'bytes' THEN floor(value)::BIGINT::VARCHAR END AS b FROM base),
newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
latest AS (SELECT * FROM newest WHERE op <> 'D')
"""
_PRINT = "CASE tag WHEN 'float' THEN round(f, 2)::VARCHAR WHEN 'int' THEN i::VARCHAR WHEN 'text' THEN s WHEN 'bytes' THEN lower(hex(b)) END"


def kv_latest(spark, d):
    return L.latest(event_log(spark, d)).select("key", "seq", "tag", "f", "i", "s", F.lower(F.hex("b")).alias("b"))


def kv_keys(spark, d):
    return L.keys(event_log(spark, d))


def kv_exists(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("user/"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("key")).distinct()
    return L.exists(event_log(spark, d), e)


def kv_history(spark, d):
    return L.history(event_log(spark, d)).select("key", "pos", "seq", "tag", "f")


def kv_live_history(spark, d):
    return L.history(event_log(spark, d), include_deleted=False).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("total"))


def kv_float_history(spark, d):
    return L.float_history(event_log(spark, d)).select("key", "pos", "f")


def kv_history_tensor(spark, d):
    floats = L.float_history(event_log(spark, d))
    chunks = L.history_tensor(floats)  # a key's history in chunks of bounded length
    ends = chunks.groupBy("key").agg(F.sum(F.size("values")).cast("int").alias("n"), F.min_by("values", "chunk").alias("a"), F.max_by("values", "chunk").alias("z"))
    return ends.select("key", "n", F.element_at("a", 1).alias("first"), F.element_at("z", -1).alias("last"))


def kv_compact(spark, d):
    return L.compacted(event_log(spark, d)).select("seq", "key", "op", "tag", "f")


def kv_point_read(spark, d):
    return L.at_offset(event_log(spark, d), 42).select("seq", "key", "tag", "f", "i", "s")


def kv_resurrections(spark, d):
    return L.resurrections(event_log(spark, d))


def kv_type_counts(spark, d):
    return L.count_by_type(event_log(spark, d))


def kv_prefix_counts(spark, d):
    return L.keys(event_log(spark, d)).groupBy(segment(F.col("key"), 2).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def kv_info(spark, d):
    return L.count_by_prefix(event_log(spark, d))


def kv_glob_keys(spark, d):
    return L.find_keys(event_log(spark, d), "user/1?/[cv]*")


def kv_prefix_keys(spark, d):
    return L.find_keys(event_log(spark, d), "user/7/*", "prefix")


def kv_contains_keys(spark, d):
    return L.find_keys(event_log(spark, d), "/pur", "contains")


def kv_typed_cast(spark, d):
    rows = L.latest(event_log(spark, d))
    return rows.select("key", as_double().alias("as_f64"), as_double("int32").alias("as_i32"), as_double("int64").alias("as_i64")).filter("as_f64 is not null")


def kv_printable(spark, d):
    return L.latest(event_log(spark, d)).filter("tag in ('int', 'text', 'bytes')").select("key", "tag", printable().alias("value"))


def kv_retention(spark, d):
    kept = L.retain(event_log(spark, d), F.lit("2024-01-15").cast("timestamp_ntz"), "user/1")
    return kept.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def delta_encode(spark, d):
    return L.delta_encode(L.float_history(event_log(spark, d))).select("key", "seq", "is_delta", "stored")


def delta_roundtrip(spark, d):
    return L.delta_decode(L.delta_encode(L.float_history(event_log(spark, d)))).select("key", "seq", "decoded")


QUERIES = {k: f for k, f in globals().items() if k.startswith(("kv_", "delta_")) and callable(f)}

_FLOATS = ", floats AS (SELECT key, seq, f, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS pos FROM log WHERE op <> 'D' AND tag = 'float')\n"
ORACLE = {
    "kv_latest": _LOG + "SELECT key, seq, tag, f, i, s, lower(hex(b)) AS b FROM latest",
    "kv_keys": _LOG + "SELECT key FROM latest",
    "kv_exists": _LOG + "SELECT DISTINCT log.key, latest.key IS NOT NULL AS present FROM log LEFT JOIN latest USING (key)",
    "kv_history": _LOG + "SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS pos, seq, tag, f FROM log WHERE op <> 'D'",
    "kv_live_history": _LOG + "SELECT key, count(*) AS n, sum(f) AS total FROM log WHERE op <> 'D' AND key IN (SELECT key FROM latest) GROUP BY key",
    "kv_float_history": _LOG + _FLOATS + "SELECT key, pos, f FROM floats",
    "kv_history_tensor": _LOG + _FLOATS + "SELECT key, count(*) AS n, arg_min(f, seq) AS first, arg_max(f, seq) AS last FROM floats GROUP BY key",
    "kv_compact": _LOG + "SELECT seq, key, op, tag, f FROM latest",
    "kv_point_read": _LOG + "SELECT seq, key, tag, f, i, s FROM log WHERE seq = 42",
    "kv_resurrections": _LOG + "SELECT key, count(*) AS n FROM (SELECT key, op, lag(op) OVER (PARTITION BY key ORDER BY seq) AS p FROM log) WHERE op <> 'D' AND p = 'D' GROUP BY key",
    "kv_type_counts": _LOG + "SELECT tag, count(*) AS n FROM latest GROUP BY tag",
    "kv_prefix_counts": _LOG + "SELECT split_part(key, '/', 3) AS kind, count(*) AS n FROM latest GROUP BY 1",
    "kv_info": _LOG + "SELECT split_part(key, '/', 1) AS prefix, count(*) AS n FROM latest GROUP BY 1",
    "kv_glob_keys": _LOG + "SELECT key FROM latest WHERE key GLOB 'user/1?/[cv]*'",
    "kv_prefix_keys": _LOG + "SELECT key FROM latest WHERE starts_with(key, 'user/7/')",
    "kv_contains_keys": _LOG + "SELECT key FROM latest WHERE contains(key, '/pur')",
    "kv_typed_cast": _LOG + "SELECT key, coalesce(f, i::DOUBLE) AS as_f64, coalesce(trunc(f)::INT, i::INT) AS as_i32, coalesce(trunc(f)::BIGINT, i) AS as_i64 FROM latest WHERE tag IN ('float', 'int')",
    "kv_printable": _LOG + f"SELECT key, tag, {_PRINT} AS value FROM latest WHERE tag IN ('int', 'text', 'bytes')",
    "kv_retention": _LOG + "SELECT key, count(*) AS n, min(seq) AS first_seq FROM log WHERE NOT (ts < TIMESTAMP '2024-01-15' AND starts_with(key, 'user/1')) GROUP BY key",
    "delta_encode": _LOG + _FLOATS + "SELECT key, seq, pos > 0 AS is_delta, CASE WHEN pos > 0 THEN f - lag(f) OVER (PARTITION BY key ORDER BY seq) ELSE f END AS stored FROM floats",
    "delta_roundtrip": _LOG + _FLOATS + "SELECT key, seq, f AS decoded FROM floats",
}
