"""Import and export queries: what comes back from a format is compared with what the log holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.catalog.kv import _LOG, event_log
from emberlog.sources import exchange as X
from emberlog.sources.frames import from_wide
from emberlog.sources.tables import table
from emberlog.streaming.streams import shared_folder


def io_records(spark, d):
    return X.records(event_log(spark, d)).filter("type <> 'float'")


def io_jsonl_lines(spark, d):
    return X.json_lines(event_log(spark, d)).select(F.get_json_object("value", "$.key").alias("key"), F.get_json_object("value", "$.value").try_cast("double").alias("number"))


def _back(rows):
    return rows.select("key", "tag", "f", "i", "s", F.lower(F.hex("b")).alias("b"))


def io_csv_roundtrip(spark, d):
    out = shared_folder(spark, "csv")
    X.export_csv(event_log(spark, d), out)
    return _back(X.import_csv(spark, out))


def io_parquet_roundtrip(spark, d):
    out = shared_folder(spark, "parquet")
    X.export_parquet(event_log(spark, d), out)
    return _back(X.import_parquet(spark, out, prefix="copy/"))


def io_jsonl_roundtrip(spark, d):
    out = shared_folder(spark, "jsonl")
    X.export_jsonl(event_log(spark, d), out)
    return X.import_jsonl(spark, out).select("key", "tag", "f", "i", "s")


def io_from_frame(spark, d):
    wide = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return from_wide(wide, "customer/", order="c_custkey").select("key", "pos", "tag", "f", "s")


QUERIES = {k: f for k, f in globals().items() if k.startswith("io_") and callable(f)}

ORACLE = {
    "io_records": _LOG + "SELECT key, tag AS type, CASE tag WHEN 'int' THEN i::VARCHAR WHEN 'text' THEN s WHEN 'bytes' THEN lower(hex(b)) END AS value FROM latest WHERE tag <> 'float'",
    "io_jsonl_lines": _LOG + "SELECT key, coalesce(f, i::DOUBLE, try_cast(lower(hex(b)) AS DOUBLE)) AS number FROM latest",
    "io_csv_roundtrip": _LOG + "SELECT key, tag, f, i, s, lower(hex(b)) AS b FROM latest",
    "io_parquet_roundtrip": _LOG + "SELECT 'copy/' || key AS key, tag, f, i, s, lower(hex(b)) AS b FROM latest",
    "io_jsonl_roundtrip": _LOG + "SELECT key, CASE tag WHEN 'bytes' THEN 'text' ELSE tag END AS tag, f, i, coalesce(s, lower(hex(b))) AS s FROM latest",
    "io_from_frame": """WITH r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
SELECT 'customer/c_name' AS key, pos, 'text' AS tag, NULL::DOUBLE AS f, c_name AS s FROM r WHERE c_name IS NOT NULL UNION ALL SELECT 'customer/c_acctbal', pos, 'float', c_acctbal, NULL FROM r WHERE c_acctbal IS NOT NULL""",
}
