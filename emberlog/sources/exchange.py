"""Import and export of key/value data: JSON, JSON lines, CSV, Parquet, Arrow, MessagePack, CBOR.

Exports write the live values by their tag (never by trying types in turn), one file part per task. Records are
{key, type, value} (CSV, Parquet, Arrow) or {key, value} (JSON lines, MessagePack, CBOR); bytes are lower-case hex in the text
formats, a vector is a list. Pickle is left out: loading it runs code.
"""

from __future__ import annotations

import json
import math
import os
import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.atoms import TYPES, atom, printable
from emberlog.functions.patterns import key_matches
from emberlog.operators.log import latest, valid_key


def selected(log: DataFrame, pattern: str = "*") -> DataFrame:
    return latest(log.filter(key_matches(F.col("key"), pattern)))


def records(log: DataFrame, pattern: str = "*") -> DataFrame:
    """key, type, value (text) of the live keys; a stored null has a null value."""
    return selected(log, pattern).select("key", F.col("tag").alias("type"), printable().alias("value"))


def json_lines(log: DataFrame, pattern: str = "*") -> DataFrame:
    """value: one JSON record {"key", "value"} per live key, the value with its own JSON type (NaN and infinities as text)."""
    rows = selected(log, pattern)
    number = F.when(F.isnan("f") | (F.abs("f") == float("inf")), F.to_json(F.array(F.col("f").cast("string")))).otherwise(F.to_json(F.array("f")))
    inner = (
        F.when(F.col("tag") == "float", number)
        .when(F.col("tag") == "int", F.to_json(F.array("i")))
        .when(F.col("tag") == "text", F.to_json(F.array("s")))
        .when(F.col("tag") == "bytes", F.to_json(F.array(F.lower(F.hex("b")))))
        .when(F.col("tag") == "vector", F.to_json(F.array("v")))
        .otherwise(F.lit("[null]"))
    )
    name = F.to_json(F.array("key"))
    bare = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)
    return rows.select(F.concat(F.lit('{"key":'), bare(name), F.lit(',"value":'), bare(inner), F.lit("}")).alias("value"))


def export_jsonl(log: DataFrame, path: str, pattern: str = "*") -> int:
    json_lines(log, pattern).write.mode("overwrite").text(path)
    return log.sparkSession.read.text(path).count()


def export_json(log: DataFrame, path: str, pattern: str = "*", most: int = 5_000_000) -> int:
    """One JSON object key -> value, written by the driver as the rows stream in; more than ``most`` records are refused (use JSON lines)."""
    if selected(log, pattern).limit(most + 1).count() > most:
        raise ValueError(f"more than {most} records: export to JSON lines")
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
        for n, row in enumerate(json_lines(log, pattern).toLocalIterator(), 1):
            r = json.loads(row["value"])
            f.write(("," if n > 1 else "") + json.dumps(r["key"]) + ":" + json.dumps(r["value"]))
        f.write("}")
    return n


def export_csv(log: DataFrame, path: str, pattern: str = "*") -> int:
    r = records(log, pattern)
    r.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return r.count()


def export_parquet(log: DataFrame, path: str, pattern: str = "*") -> int:
    records(log, pattern).write.mode("overwrite").parquet(path)
    return log.sparkSession.read.parquet(path).count()


def export_arrow(log: DataFrame, path: str, pattern: str = "*", most: int = 5_000_000) -> int:
    """A Feather file on the driver; more than ``most`` records are refused (use Parquet)."""
    from pyarrow import feather

    r = records(log, pattern).limit(most + 1).toArrow()
    if r.num_rows > most:
        raise ValueError(f"more than {most} records: export to Parquet")
    feather.write_feather(r, path)
    return r.num_rows


def msgpack(x) -> bytes:
    """One value in MessagePack."""
    if x is None:
        return b"\xc0"
    if isinstance(x, bool):
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, int):
        if 0 <= x < 128:
            return struct.pack("B", x)
        return b"\xd3" + struct.pack(">q", x)
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, str):
        b = x.encode()
        return (struct.pack("B", 0xA0 | len(b)) if len(b) < 32 else b"\xdb" + struct.pack(">I", len(b))) + b
    if isinstance(x, (bytes, bytearray)):
        return b"\xc6" + struct.pack(">I", len(x)) + bytes(x)
    if isinstance(x, dict):
        return b"\xdf" + struct.pack(">I", len(x)) + b"".join(msgpack(k) + msgpack(v) for k, v in x.items())
    return b"\xdd" + struct.pack(">I", len(x)) + b"".join(msgpack(v) for v in x)


def cbor(x) -> bytes:
    """One value in CBOR."""

    def head(major: int, n: int) -> bytes:
        return struct.pack("B", major << 5 | n) if n < 24 else struct.pack(">BQ", major << 5 | 27, n)

    if x is None:
        return b"\xf6"
    if isinstance(x, bool):
        return b"\xf5" if x else b"\xf4"
    if isinstance(x, int):
        return head(0, x) if x >= 0 else head(1, -1 - x)
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, str):
        return head(3, len(x.encode())) + x.encode()
    if isinstance(x, (bytes, bytearray)):
        return head(2, len(x)) + bytes(x)
    if isinstance(x, dict):
        return head(5, len(x)) + b"".join(cbor(k) + cbor(v) for k, v in x.items())
    return head(4, len(x)) + b"".join(cbor(v) for v in x)


def export_binary(log: DataFrame, folder: str, encode: Callable[[object], bytes], pattern: str = "*") -> int:
    """Files of {key, value} records in MessagePack or CBOR (``encode``), one per task, in a folder that all workers share."""
    rows = selected(log, pattern).select("key", *("tag", *TYPES))
    os.makedirs(folder, exist_ok=True)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        n, target = 0, f"{folder}/part-{context.partitionId():05d}"
        with open(f"{target}.{context.taskAttemptId()}.tmp", "wb") as f:
            for frame in frames:
                for r in frame.itertuples(index=False):
                    value = {"float": r.f, "int": None if pd.isna(r.i) else int(r.i), "text": r.s, "bytes": r.b, "vector": None if r.v is None else [float(e) for e in r.v]}.get(r.tag)
                    f.write(encode({"key": r.key, "value": value}))
                    n += 1
        os.replace(f.name, target)
        yield pd.DataFrame({"n": [n]})

    return rows.mapInPandas(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def to_rows(pairs: DataFrame, prefix: str = "") -> DataFrame:
    """(key, type, value text) -> log rows (key, tag, payload); empty keys are skipped, unknown types and unreadable numbers are text."""
    ok = pairs.filter(F.col("key").isNotNull() & (F.col("key") != "")).withColumn("key", F.concat(F.lit(prefix), "key")).filter(valid_key(F.col("key")))
    f, i = F.col("value").try_cast("double"), F.col("value").try_cast("bigint")
    tag = (
        F.when(F.col("value").isNull(), "null").when((F.col("type") == "float") & f.isNotNull(), "float").when((F.col("type") == "int") & i.isNotNull(), "int")
        .when(F.col("type") == "bytes", "bytes").when(F.col("type") == "vector", "vector").otherwise("text")
    )
    t = ok.withColumn("tag", tag)
    pick = lambda name, c: F.when(F.col("tag") == name, c)
    return t.select("key", "tag", pick("float", f).alias("f"), pick("int", i).alias("i"), pick("text", F.col("value")).alias("s"), pick("bytes", F.unhex("value")).alias("b"), pick("vector", F.from_json("value", "array<float>")).alias("v"))


def import_csv(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    return to_rows(spark.read.option("header", True).option("escape", '"').schema("key string, type string, value string").csv(path), prefix)


def import_parquet(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    return to_rows(spark.read.parquet(path).select("key", "type", "value"), prefix)


def _typed_json(value) -> tuple[str, str | None]:
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "int", str(int(value))
    if isinstance(value, int):
        return "int", str(value)
    if isinstance(value, float):
        return "float", repr(value) if math.isfinite(value) else str(value)
    if isinstance(value, str):
        return "text", value
    return "text", json.dumps(value)


def import_jsonl(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Records {key, value}, typed by their JSON type (a boolean is an int, lists and objects are text); blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")

    def parse(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            keys, kinds, values = [], [], []
            for line in b.column(0).to_pylist():
                r = json.loads(line)
                k, v = _typed_json(r.get("value"))
                keys.append(r.get("key"))
                kinds.append(k)
                values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["key", "type", "value"])

    return to_rows(lines.mapInArrow(parse, "key string, type string, value string"), prefix)


def import_json(spark: SparkSession, path: str, prefix: str = "", most: int = 1 << 30) -> DataFrame:
    """One JSON object key -> value, read by the driver; a file of more than ``most`` bytes is refused (use JSON lines)."""
    if os.path.getsize(path) > most:
        raise ValueError(f"more than {most} bytes: import JSON lines")
    with open(path, encoding="utf-8") as f:
        rows = [(k, *_typed_json(v)) for k, v in json.load(f).items()]
    return to_rows(spark.createDataFrame(rows, "key string, type string, value string"), prefix)


def numbers(frame: pd.DataFrame) -> pd.DataFrame:
    """A frame with NumPy columns only, as array stores take it."""
    return frame.select_dtypes("number")


def stored_null(spark: SparkSession, key: str) -> DataFrame:
    return spark.range(1).select(F.lit(key).alias("key"), *atom())
