"""The append-only log and its views. Everything else is derived from rows (seq, ts, key, op, tag, f, i, s, b, v).

``seq`` orders the writes of a store; ``op`` is 'P' (put) or 'D' (tombstone). Views are plain DataFrames, so filters on key
reach the scan. Latest values come from an aggregation (``max_by``), which is combined on the map side: a key that holds a
third of the log sends one row a task, not its history. Places in a history are numbered range by range, so that such a key
takes several tasks.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.errors import EmptyKey, KeyTooLong, StoreNotFound
from emberlog.functions.atoms import TYPES, atom
from emberlog.functions.patterns import key_matches
from emberlog.operators.numbering import number_in_keys
from emberlog.plans.session import cut

LOG_SCHEMA = "seq bigint, ts timestamp, key string, op string, tag string, f double, i bigint, s string, b binary, v array<float>"
VALUE = ("tag", *TYPES)
MAX_KEY_BYTES = 65_535


def check_key(key: str) -> str:
    if not key:
        raise EmptyKey("a key has at least one character")
    if len(key.encode()) > MAX_KEY_BYTES:
        raise KeyTooLong(f"a key has at most {MAX_KEY_BYTES} bytes")
    return key


def valid_key(key: Column) -> Column:
    return key.isNotNull() & (F.length(key) > 0) & (F.octet_length(key) <= MAX_KEY_BYTES)


def newest(log: DataFrame) -> DataFrame:
    """The last row of every key, tombstones included."""
    cols = [c for c in log.columns if c != "key"]
    return log.groupBy("key").agg(F.max_by(F.struct(*cols), F.struct("seq")).alias("r")).select("key", "r.*")


def latest(log: DataFrame) -> DataFrame:
    """The live keys with their last value; a key whose last row is a tombstone is absent, one written again is back."""
    return newest(log).filter(F.col("op") != "D")


def keys(log: DataFrame) -> DataFrame:
    return latest(log).select("key")


def exists(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (key) with a flag ``present``; a stored null is present."""
    live = keys(log).withColumn("present", F.lit(True))
    return wanted.join(live, "key", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def history(log: DataFrame, include_deleted: bool = True) -> DataFrame:
    """Every value ever put, with its place in the key's history from 0 (write order), also from before a delete.

    include_deleted=False leaves out keys that are deleted now.
    """
    puts = log.filter(F.col("op") != "D")
    if not include_deleted:
        puts = puts.join(keys(log), "key", "left_semi")
    return number_in_keys(puts, ["key"], ["seq"])


def float_history(log: DataFrame) -> DataFrame:
    """key, pos, f: the floats of every key's history, in order; other tags (int too) are left out."""
    floats = log.filter("op <> 'D' and tag = 'float'")
    return number_in_keys(floats.select("key", "seq", "f"), ["key"], ["seq"]).select("key", "pos", "seq", "f")


def history_tensor(floats: DataFrame, chunk: int = 65_536) -> DataFrame:
    """key, chunk, values: the float history (``float_history``) of every key as arrays of at most ``chunk`` values, so no key is one row."""
    pairs = F.sort_array(F.collect_list(F.struct("pos", "f")))
    cells = floats.withColumn("chunk", F.floor(F.col("pos") / chunk)).groupBy("key", "chunk").agg(pairs.alias("p"))
    return cells.select("key", "chunk", F.transform("p", lambda x: x["f"]).alias("values"))


def at_offset(log: DataFrame, seq: int) -> DataFrame:
    """The single write with this sequence number."""
    return log.filter(F.col("seq") == seq)


def compacted(log: DataFrame) -> DataFrame:
    """The log after compaction: one put per live key, with its own seq and time; no history, no tombstones."""
    return latest(log)


def resurrections(log: DataFrame) -> DataFrame:
    """key, n: how often a put followed a tombstone of the same key."""
    placed = number_in_keys(log.select("key", "seq", "op"), ["key"], ["seq"])
    puts = placed.filter("op <> 'D'").select("key", (F.col("pos") - 1).alias("pos"))  # the place before each put
    return placed.filter("op = 'D'").join(puts, ["key", "pos"]).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def delta_encode(series: DataFrame, key: str = "key", order: str = "seq", value: str = "f", block: int = 4096) -> DataFrame:
    """Adds ``stored`` and ``is_delta``: the difference to the value before, the first of a key and of every ``block`` values absolute.

    A block is encoded and decoded by itself, so a key with very many values takes many tasks.
    """
    placed = number_in_keys(series, [key], [order], "__pos").withColumn("__block", F.floor(F.col("__pos") / block))
    before = F.lag(value).over(Window.partitionBy(key, "__block").orderBy("__pos"))
    out = placed.withColumn("__before", before).withColumn("is_delta", F.col("__before").isNotNull())
    return out.withColumn("stored", F.when(F.col("is_delta"), F.col(value) - F.col("__before")).otherwise(F.col(value))).drop("__pos", "__block", "__before")


def delta_decode(encoded: DataFrame, key: str = "key", order: str = "seq", stored: str = "stored", is_delta: str = "is_delta", value: str = "decoded", block: int | None = 4096) -> DataFrame:
    """Running sums of the differences, begun anew at every absolute value. ``block``: as it was encoded with; None: a key is one sequence."""
    placed = number_in_keys(encoded, [key], [order], "__pos").withColumn("__block", F.floor(F.col("__pos") / block) if block else F.lit(0))
    by = Window.partitionBy(key, "__block").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    chain = placed.withColumn("__chain", F.sum(F.when(F.col(is_delta), 0).otherwise(1)).over(by))
    in_chain = Window.partitionBy(key, "__block", "__chain").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    return chain.withColumn(value, F.sum(stored).over(in_chain)).drop("__chain", "__pos", "__block")


def retain(log: DataFrame, since: Column, prefix: str | None = None) -> DataFrame:
    """The log without puts before ``since`` (of keys with the prefix, if given)."""
    old = F.col("ts") < since
    if prefix is not None:
        old = old & F.col("key").startswith(prefix)
    return log.filter(~F.coalesce(old, F.lit(False)))


def count_by_prefix(log: DataFrame) -> DataFrame:
    """prefix, n: live keys by their first '/' segment."""
    return keys(log).groupBy(F.split("key", "/").getItem(0).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def count_by_type(log: DataFrame) -> DataFrame:
    """tag, n: live keys by the tag of their last value."""
    return latest(log).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def find_keys(log: DataFrame, pattern: str, mode: str = "glob") -> DataFrame:
    return keys(log.filter(key_matches(F.col("key"), pattern, mode)))


@dataclass(frozen=True)
class StoreConfig:
    """compression: the files' codec. delta: numbers and texts are stored as differences (Parquet's delta encodings). sync: every
    single put and delete is written at once; without it they are kept until ``flush``, an ``append``, ``compact`` or ``close``."""

    compression: str = "zstd"
    delta: bool = False
    sync: bool = True


class LogStore:
    """A log in a folder of Parquet files. Reading is lazy; every append is one atomic job.

    Writers take the next sequence numbers from ``max(seq)`` and add a dense number in the order given, so two writers of one
    store must take turns (as in the single-writer model of an embedded log).
    """

    def __init__(self, spark: SparkSession, path: str, create: bool = True, config: StoreConfig | None = None):
        self.spark, self.path, self.config = spark, path, config or StoreConfig()
        self._kept: list[tuple[str, str, str | None, object]] = []  # puts and deletes that are not written yet
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs, self._path = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path
        self._recover()
        if not self._fs.exists(jvm_path):
            if not create:
                raise StoreNotFound(path)
            self._writer(spark.createDataFrame([], LOG_SCHEMA)).parquet(path)

    def _writer(self, rows: DataFrame, mode: str = "error"):
        writer = rows.write.mode(mode).option("compression", self.config.compression)
        return writer.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false") if self.config.delta else writer

    def _recover(self) -> None:
        """Ends or undoes a compaction that broke off: the old log is there until the new one is whole and in its place."""
        old, new = self._path.suffix("-before"), self._path.suffix("-compacting")
        if self._fs.exists(old) and not self._fs.exists(self._path):
            whole = self._fs.exists(new.suffix("/_SUCCESS"))
            self._fs.rename(new if whole else old, self._path)
        for left in (old, new):
            if self._fs.exists(self._path) and self._fs.exists(left):
                self._fs.delete(left, True)

    def log(self) -> DataFrame:
        written = self.spark.read.schema(LOG_SCHEMA).parquet(self.path)
        if not self._kept:
            return written
        first = self._next()
        rows = self._rows(self._kept).withColumn("seq", F.col("n") + first).withColumn("ts", F.current_timestamp())
        return written.unionByName(rows.select([F.col(c).cast(kind).alias(c) for c, kind in (x.split(None, 1) for x in LOG_SCHEMA.split(", "))]))

    def _next(self) -> int:
        return (self.spark.read.schema(LOG_SCHEMA).parquet(self.path).agg(F.max("seq")).first()[0] or 0) + 1

    def append(self, rows: DataFrame, order: list[Column] | None = None) -> int:
        """Appends (key, tag, f, i, s, b, v[, op, ts]) rows in the given order; the number of rows. Invalid keys raise."""
        self.flush()
        return self._append(rows, order)

    def _append(self, rows: DataFrame, order: list[Column] | None = None) -> int:
        bad = rows.filter(~valid_key(F.col("key"))).limit(1).count()
        if bad:
            raise EmptyKey("a row has an empty or overlong key")
        numbered = rows
        for name, default in (("op", F.lit("P")), ("ts", F.current_timestamp())):
            if name not in rows.columns:
                numbered = numbered.withColumn(name, default)
        # dense numbers without a single task: by range partition, then offsets of the partitions
        numbered = numbered.sort(*(order or [F.monotonically_increasing_id()])).withColumn("__p", F.spark_partition_id())
        numbered = numbered.withColumn("__n", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("bigint"), 33))
        numbered = cut(numbered)  # the numbers must be the same if a task runs again
        sizes = numbered.groupBy("__p").agg(F.count(F.lit(1)).alias("c"))
        before = F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
        total = sizes.agg(F.sum("c")).first()[0]
        if not total:
            return 0
        out = numbered.join(sizes.select("__p", (before + self._next()).alias("__first")), "__p").withColumn("seq", F.col("__first") + F.col("__n"))
        columns = [c.split(None, 1) for c in LOG_SCHEMA.split(", ")]
        self._writer(out.select([F.col(c).cast(kind).alias(c) for c, kind in columns]), "append").parquet(self.path)
        return total

    def _rows(self, kept: list[tuple[str, str, str | None, object]]) -> DataFrame:
        """n, key, op and the atom's columns of single writes (key, op, payload column, value)."""
        parts = None
        for name in dict.fromkeys(k[2] for k in kept):
            some = [(n, k[0], k[1], k[3]) for n, k in enumerate(kept) if k[2] == name]
            df = self.spark.createDataFrame(some, f"n int, key string, op string, value {TYPES.get(name, 'string')}")
            df = df.select("n", "key", "op", *(atom(**{name: F.col("value")}) if name else atom()))
            parts = df if parts is None else parts.unionByName(df)
        return parts

    def flush(self) -> int:
        """Writes the puts and deletes that are kept; their number."""
        kept, self._kept = self._kept, []
        if kept:
            try:
                self._append(self._rows(kept), [F.col("n")])
            except Exception:
                self._kept = kept + self._kept
                raise
        return len(kept)

    def _keep(self, key: str, op: str, name: str | None, value) -> None:
        self._kept.append((key, op, name, value))
        if self.config.sync:
            self.flush()

    def put(self, key: str, **payload) -> None:
        """One value: f=, i=, s=, b= or v= (none: a stored null). For many values use ``append``."""
        check_key(key)
        name, value = next(iter(payload.items()), (None, None))
        if name is not None and name not in TYPES:
            raise ValueError(f"no such payload: {name}")
        self._keep(key, "P", name, value)

    def put_floats(self, key: str, values: list[float]) -> int:
        """A batch of floats under one key, in order; 0 for an empty batch."""
        check_key(key)
        if not values:
            return 0
        rows = self.spark.createDataFrame([(float(x), n) for n, x in enumerate(values)], "value double, n int")
        return self.append(rows.select(F.lit(key).alias("key"), *atom(f=F.col("value")), "n"), [F.col("n")])

    def delete(self, key: str) -> None:
        """A tombstone, also for a key that was never put."""
        check_key(key)
        self._keep(key, "D", None, None)

    def delete_matching(self, pattern: str, mode: str = "glob") -> int:
        """Tombstones for all live keys that match; their number."""
        found = find_keys(self.log(), pattern, mode)
        return self.append(found.select("key", F.lit("D").alias("op"), *atom()), [F.col("key")])

    def get(self, key: str) -> dict | None:
        row = latest(self.log().filter(F.col("key") == key)).first()
        return None if row is None else {c: row[c] for c in VALUE}

    def compact(self) -> tuple[int, int]:
        """Rewrites the log to its live values beside the old one, then swaps; (bytes before, bytes after)."""
        self.flush()
        before = self._fs.getContentSummary(self._path).getLength()
        new, old = self._path.suffix("-compacting"), self._path.suffix("-before")
        self._writer(compacted(self.log()).select(*[c.split()[0] for c in LOG_SCHEMA.split(", ")]), "overwrite").parquet(new.toString())
        # a stop between any two of these steps is put right by the next opening (``_recover``)
        self._fs.rename(self._path, old)
        self._fs.rename(new, self._path)
        self._fs.delete(old, True)
        return before, self._fs.getContentSummary(self._path).getLength()

    def close(self) -> None:
        self.flush()


_STORES: dict[str, LogStore] = {}


def open_store(spark: SparkSession, path: str, create: bool = True, config: StoreConfig | None = None) -> LogStore:
    """The store of a path; opening it again gives the same one."""
    full = os.path.abspath(path) if "://" not in path else path
    if full not in _STORES:
        _STORES[full] = LogStore(spark, full, create, config)
    return _STORES[full]


def close_store(path: str) -> None:
    """Writes what an open store keeps and forgets it; an unknown path is an error."""
    full = os.path.abspath(path) if "://" not in path else path
    store = _STORES.pop(full, None)
    if store is None:
        raise StoreNotFound(path)
    store.close()
