"""Structured Streaming over event files: windows, sessions, deduplication, stateful rolling features, anomalies, latest values, counters.

All sources are files, all sinks are folders. A run given a ``folder`` can be stopped and begun again: the next run with that folder goes on
from its checkpoint and reads only files it has not seen. State is kept per key and bounded: a watermark closes windows, drops what comes
later than it, and forgets seen keys; rolling state holds the last n values of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberlog.operators.anomaly import WindowModel
from emberlog.plans.session import scratch


def stream_files(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder (or of one file), some files a trigger."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern: a stream's source may then be a single file too


def event_time(df: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The stream with a zoned event time and a watermark; times without zone are read as UTC."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col(ts).cast("timestamp_ntz"))
    return df.withColumn(ts, F.timestamp_micros(micros)).withWatermark(ts, delay)


def tumbling(df: DataFrame, size: str, keys: list[str], value: str = "value", ts: str = "ts", slide: str | None = None) -> DataFrame:
    """Count and sum per window (sliding, if ``slide``) and keys."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.unix_seconds("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, gap: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """Count per session: events of a key with less than ``gap`` between them."""
    return df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("start"), *keys, "n")


def deduplicated(df: DataFrame, columns: list[str]) -> DataFrame:
    """The first of every content within the watermark."""
    return df.dropDuplicatesWithinWatermark(columns)


def rolling_state(df: DataFrame, n: int, key: str, order: str, value: str) -> DataFrame:
    """key, order, mean, low, high, ready of the last n values at every arrival; state is the last n (order, value) pairs of a key."""
    kind = dict(df.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for o, v in zip(rows[order].tolist(), rows[value].tolist()):
            last = [*last, float(v)][-n:]
            out.append((k[0], o, sum(last) / len(last), min(last), max(last), len(last) == n))
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, order, "mean", "low", "high", "ready"])

    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} bigint, mean double, low double, high double, ready boolean", "last array<double>", "append", GroupStateTimeout.NoTimeout)


def step_counter(df: DataFrame, key: str, order: str) -> DataFrame:
    """key, order, step: a counter per key that goes on across triggers."""
    kind = dict(df.dtypes)[key]

    def count(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        state.update((at + len(rows),))
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), "step": range(at, at + len(rows))})

    return df.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, {order} bigint, step bigint", "at bigint", "append", GroupStateTimeout.NoTimeout)


def anomalies(df: DataFrame, model: WindowModel, key: str, order: str, value: str) -> DataFrame:
    """key, order, ready, score, anomaly at every arrival: the score of the last ``model.window`` values; state is these values of a key."""
    kind, n, parts = dict(df.dtypes)[key], model.window, np.array(model.components)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable").dropna(subset=[value])
        z = ((rows[value] - model.mean) / (model.std + 1e-8)).tolist()
        all_ = np.array([*(state.get[0] if state.exists else []), *z], dtype=float)
        held = len(all_) - len(z)
        score, ready = np.zeros(len(z)), np.arange(held + 1, len(all_) + 1) >= n
        if ready.any():
            w = np.lib.stride_tricks.sliding_window_view(all_, n)[-int(ready.sum()) :]
            score[ready] = np.maximum(((w * w).sum(axis=1) - ((w @ parts.T) ** 2).sum(axis=1)) / n, 0.0)
        state.update((all_[-(n - 1) :].tolist() if n > 1 else [],))
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), "ready": ready, "score": score, "anomaly": ready & (score > model.threshold)})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} bigint, ready boolean, score double, anomaly boolean", "last array<double>", "append", GroupStateTimeout.NoTimeout)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return scratch(spark, name)


def run_to_end(df: DataFrame, mode: str = "append", name: str = "stream", each: Callable[[DataFrame, int], None] | None = None, folder: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now and gives the sink's rows.

    ``folder`` holds checkpoint and rows: a later run with the same one goes on where this one ended, and gives the rows of both.
    Append mode writes Parquet files. Update and complete mode write every trigger's rows to the same kind of folder with the
    trigger's number; of complete mode the last trigger is given, of update mode every trigger (``newest`` picks the last row).
    """
    spark = df.sparkSession
    out = folder or shared_folder(spark, name)
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/checkpoint")
    if each is not None:
        writer.foreachBatch(each).start().awaitTermination()
        return spark.createDataFrame([], df.schema)
    if mode == "append":
        writer.format("parquet").option("path", f"{out}/rows").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{out}/rows")

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("trigger", F.lit(n)).write.mode("overwrite").parquet(f"{out}/rows/{n:06d}")

    writer.foreachBatch(keep).start().awaitTermination()
    rows = spark.read.schema(StructType([*df.schema.fields, StructField("trigger", IntegerType())])).parquet(f"{out}/rows/*")
    if mode == "complete":
        last = rows.agg(F.max("trigger").alias("trigger"))
        return rows.join(last, "trigger", "left_semi").drop("trigger")
    return rows


def run_closed(stream: DataFrame, build: Callable[[DataFrame], DataFrame], closing: DataFrame, name: str = "closed", folder: str | None = None) -> DataFrame:
    """Runs ``build(stream)`` in append mode over all that is there, then once more from the checkpoint with ``closing`` rows.

    The closing rows are later than all windows, so the watermark passes these and every window is given, once. What they open themselves
    stays open. Rows that come later than the watermark are dropped, as in any append mode.
    """
    spark = stream.sparkSession
    out = folder or shared_folder(spark, name)
    closing.limit(0).write.mode("overwrite").parquet(f"{out}/closing")
    built = build(stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{out}/closing")))
    run_to_end(built, folder=out)
    closing.write.mode("append").parquet(f"{out}/closing")
    return run_to_end(built, folder=out)


def newest(rows: DataFrame, keys: list[str], order: Column | str = "trigger") -> DataFrame:
    """Of update mode's rows the last of every key."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("r")).select(*keys, "r.*").drop("trigger")


def upsert_latest(df: DataFrame, key: str, order: str, columns: list[str], name: str = "latest", folder: str | None = None, fold: int = 16) -> DataFrame:
    """Streams into a table of the latest row of every key.

    Every trigger writes the latest rows of its own keys only, under its number, so one that is run again writes the same; every ``fold``-th
    trigger folds all there is into a new base. The table is the last base and what came after it, and what is there is read from the folder:
    a run with the same folder goes on.
    """
    spark = df.sparkSession
    out = folder or shared_folder(spark, name)
    schema = df.select(key, order, *columns).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.max_by(F.struct(order, *columns), order).alias("r")).select(key, "r.*")

    def whole(kind: str) -> list[int]:
        found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{kind}-*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName().split("-")[1]) for f in found or [])

    def table(until: int | None = None) -> DataFrame:
        bases = [n for n in whole("base") if until is None or n < until]
        base = bases[-1] if bases else -1
        parts = [f"{out}/base-{base:09d}"] if bases else []
        parts += [f"{out}/part-{n:09d}" for n in whole("part") if n > base and (until is None or n <= until)]
        return latest(spark.read.schema(schema).parquet(*parts)) if parts else spark.createDataFrame([], schema)

    def merge(batch: DataFrame, n: int) -> None:
        latest(batch.select(key, order, *columns)).write.mode("overwrite").parquet(f"{out}/part-{n:09d}")
        if n % fold == fold - 1:
            table(n).write.mode("overwrite").parquet(f"{out}/base-{n:09d}")

    run_to_end(df, name=name, each=merge, folder=out)
    return table()


def ingest_hot(df: DataFrame, columns: list[str], name: str = "hot") -> DataFrame:
    """Streams rows into a hot tier of files; ``knn.promote`` moves them on, ``knn.merge_tiers`` searches both tiers meanwhile."""
    return run_to_end(df.select(*columns), "append", name)
