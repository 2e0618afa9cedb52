"""Stores over one log: dense vectors, sparse vectors, hot and cold tiers, models, experiments, transitions, messages, documents.

A store is a name space of keys in a ``LogStore``. Values are appended, never changed; reading takes the last row of a key, so
an index can't be stale. Every method that reads gives a DataFrame, except those that ask for one value.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.errors import ChecksumMismatch, DimensionMismatch, KeyNotFound, RunEnded
from emberlog.functions.atoms import atom
from emberlog.operators import knn, registry, sparse
from emberlog.operators.ann import HashIndex, ListIndex
from emberlog.operators.log import LogStore, history, latest
from emberlog.plans.session import cut


class VectorStore:
    """Vectors of one length under ``vec/<key>``; a key written again counts with its last vector, or its first (``keep='first'``)."""

    def __init__(self, store: LogStore, dims: int, metric: str = "cosine", prefix: str = "vec/", keep: str = "last"):
        self.store, self.dims, self.metric, self.prefix, self.keep = store, dims, metric, prefix, keep

    def rows(self) -> DataFrame:
        """key, vector of the live keys."""
        mine = self.store.log().filter(F.col("key").startswith(self.prefix))
        live = latest(mine).filter("tag = 'vector'")
        if self.keep == "first":
            firsts = knn.first_write(mine.filter("op <> 'D' and tag = 'vector'").select("key", "seq", "v"))
            live = firsts.join(live.select("key"), "key", "left_semi")
        return live.select(F.substring(F.col("key"), F.lit(len(self.prefix) + 1), F.length("key")).alias("key"), F.col("v").alias("vector"))

    def insert(self, key: str, vector: Sequence[float]) -> None:
        if len(vector) != self.dims:
            raise DimensionMismatch(f"{self.dims} dimensions, not {len(vector)}")
        self.store.put(self.prefix + key, v=[float(x) for x in vector])

    def insert_batch(self, vectors: DataFrame) -> int:
        """Appends (key, vector) rows; the number of keys that are new."""
        checked = knn.check_dims(vectors.select("key", "vector"), self.dims)
        new = checked.select("key").distinct().join(self.rows().select("key"), "key", "left_anti").count()
        self.store.append(checked.select(F.concat(F.lit(self.prefix), "key").alias("key"), *atom(v=F.col("vector"))))
        return new

    def get(self, key: str) -> list[float] | None:
        got = self.store.get(self.prefix + key)
        return got["v"] if got and got["tag"] == "vector" else None

    def delete(self, key: str) -> None:
        self.store.delete(self.prefix + key)

    def __len__(self) -> int:
        return self.rows().count()

    def build_index(self, path: str, index: ListIndex | HashIndex | None = None) -> ListIndex | HashIndex:
        """Fits (lists) and writes an index of the live vectors; vectors that come later are added to it by its ``insert``."""
        rows = self.rows()
        index = index or ListIndex(metric=self.metric)
        if isinstance(index, ListIndex) and index.centres is None:
            index.fit(rows)
        return index.save(rows, path)

    def search(self, query: Sequence[float], k: int, index: ListIndex | HashIndex | None = None, nprobe: int | None = None) -> DataFrame:
        """key, score, vector of the k closest: exact, or by a stored index, whose hits are held against the live vectors.

        An index may have vectors that were deleted or written again: more than k are asked of it, and what is not live is left out.
        """
        if len(query) != self.dims:
            raise DimensionMismatch(f"{self.dims} dimensions, not {len(query)}")
        rows = self.rows()
        if index is None:
            return knn.search(rows, list(query), k, self.metric).join(rows, "key").orderBy("score", "key")
        spark = self.store.spark
        q = spark.createDataFrame([("q", [float(x) for x in query])], "qid string, vector array<float>")
        found = index.search(index.stored(spark), q, 4 * k, nprobe) if isinstance(index, ListIndex) else index.search(*index.stored(spark), q, 4 * k)
        live = rows.join(F.broadcast(found.select("key").distinct()), "key", "left_semi")  # 4 k keys
        return knn.search(live, list(query), k, self.metric).join(live, "key").orderBy("score", "key")


class SparseStore:
    """Sparse vectors as rows (doc_id, key, term_id, weight) in a folder; indexing a key again makes its older document stale."""

    SCHEMA = "doc_id bigint, key string, term_id bigint, weight double"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs, self._folder = folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder
        for part, schema in (("postings", self.SCHEMA), ("deleted", "doc_id bigint")):
            if not self._fs.exists(folder.suffix(f"/{part}")):
                spark.createDataFrame([], schema).write.parquet(f"{path}/{part}")

    def rows(self) -> DataFrame:
        """All postings, those of stale and deleted documents too."""
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/postings")

    def deleted(self) -> DataFrame:
        return self.spark.read.schema("doc_id bigint").parquet(f"{self.path}/deleted").distinct()

    def index(self, vector: Mapping[int, float], key: str | None = None) -> int:
        """The new document's id; weights that aren't positive are left out."""
        doc = (self.rows().agg(F.max("doc_id")).first()[0] or 0) + 1
        rows = [(doc, key, int(t), float(w)) for t, w in vector.items() if w > 0] or [(doc, key, None, None)]
        self.spark.createDataFrame(rows, self.SCHEMA).write.mode("append").parquet(f"{self.path}/postings")
        return doc

    def index_batch(self, vectors: DataFrame) -> None:
        """Appends (doc_id, key, term_id, weight) rows whose doc_ids the caller numbers."""
        sparse.positive(vectors).select("doc_id", "key", "term_id", F.col("weight").cast("double").alias("weight")).write.mode("append").parquet(f"{self.path}/postings")

    def documents(self) -> DataFrame:
        """doc_id, key of the live documents: of one key the newest, without those deleted."""
        docs = self.rows().select("doc_id", "key").distinct()
        newest = docs.filter("key is not null").groupBy("key").agg(F.max("doc_id").alias("doc_id"))
        return newest.select("doc_id", "key").unionByName(docs.filter("key is null")).join(self.deleted(), "doc_id", "left_anti")

    def keys(self) -> DataFrame:
        return self.documents().filter("key is not null").select("key")

    def __len__(self) -> int:
        return self.documents().count()

    def delete(self, key: str) -> bool:
        """Deletes the live document of a key, and all older ones under it; False if there is none."""
        docs = self.rows().filter(F.col("key") == key).select("doc_id").distinct().join(self.deleted(), "doc_id", "left_anti")
        found = not docs.isEmpty()
        if found:
            docs.write.mode("append").parquet(f"{self.path}/deleted")
        return found

    def delete_by_id(self, doc_id: int) -> bool:
        found = not self.documents().filter(F.col("doc_id") == doc_id).isEmpty()
        if found:
            self.spark.createDataFrame([(doc_id,)], "doc_id bigint").write.mode("append").parquet(f"{self.path}/deleted")
        return found

    def clear(self) -> None:
        """Deletes all documents; ids go on where they were."""
        cut(self.documents().select("doc_id")).write.mode("append").parquet(f"{self.path}/deleted")

    def live(self) -> DataFrame:
        """doc_id, term_id, weight of the live documents."""
        return sparse.live_index(self.rows().join(self.documents().select("doc_id"), "doc_id", "left_semi"))[0]

    def search(self, query: Mapping[int, float], k: int) -> DataFrame:
        q = self.spark.createDataFrame([(int(t), float(w)) for t, w in query.items()], "term_id bigint, weight double")
        return sparse.named(sparse.search(self.live(), q, k), self.documents().filter("key is not null"))

    def get(self, key: str) -> dict[int, float]:
        doc = self.documents().filter(F.col("key") == key).agg(F.max("doc_id")).first()[0]
        return {r.term_id: r.weight for r in self.live().filter(F.col("doc_id") == doc).collect()} if doc is not None else {}

    def stats(self) -> DataFrame:
        return sparse.index_stats(self.live())


class TieredStore:
    """A hot and a cold vector store: writes go to hot, searches see both, promotion copies to cold what it lacks."""

    def __init__(self, hot: VectorStore, cold: VectorStore):
        self.hot, self.cold = hot, cold

    def insert_batch(self, vectors: DataFrame) -> int:
        return self.hot.insert_batch(vectors)

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        return knn.merge_tiers(self.hot.search(query, k), self.cold.search(query, k), k)

    def promote(self) -> int:
        missing = self.hot.rows().join(self.cold.rows().select("key"), "key", "left_anti")
        return self.cold.insert_batch(missing)

    def keys(self) -> DataFrame:
        return self.hot.rows().select("key").union(self.cold.rows().select("key")).distinct()


class Models:
    """Model versions: bytes under model/<name>/v<version>/data, a description beside them."""

    def __init__(self, store: LogStore):
        self.store = store

    def _key(self, name: str, version: int, what: str) -> str:
        return f"model/{name}/v{version:08d}/{what}"

    def versions(self, name: str | None = None) -> DataFrame:
        """name, version, created_at, checksum, size_bytes, stage, metadata."""
        prefix = "model/" + (f"{name}/" if name else "")
        rows = latest(self.store.log().filter(F.col("key").startswith(prefix) & F.col("key").endswith("/meta"))).filter("tag = 'text'")
        schema = "name string, version int, created_at bigint, checksum string, size_bytes bigint, stage string, metadata map<string,string>"
        return rows.select(F.from_json("s", schema).alias("m")).select("m.*")

    def save(self, name: str, data: bytes, metadata: Mapping[str, str] | None = None, created_at: int = 0) -> int:
        version = (self.versions(name).agg(F.max("version")).first()[0] or 0) + 1
        meta = {"name": name, "version": version, "created_at": created_at, "checksum": hashlib.sha256(data).hexdigest(), "size_bytes": len(data), "stage": "Development", "metadata": dict(metadata or {})}
        self.store.put(self._key(name, version, "data"), b=bytearray(data))
        self.store.put(self._key(name, version, "meta"), s=json.dumps(meta))
        return version

    def load(self, name: str, version: int | None = None) -> bytes:
        rows = self.versions(name)
        row = (rows.filter(F.col("version") == version) if version else rows.orderBy(F.desc("version"))).first()
        if row is None:
            raise KeyNotFound(f"{name} {version or ''}")
        data = bytes(self.store.get(self._key(name, row["version"], "data"))["b"])
        if hashlib.sha256(data).hexdigest() != row["checksum"]:
            raise ChecksumMismatch(f"{name} {row['version']}")
        return data

    def set_stage(self, name: str, version: int, stage: str) -> None:
        row = self.versions(name).filter(F.col("version") == version).first()
        if row is None:
            raise KeyNotFound(f"{name} {version}")
        self.store.put(self._key(name, version, "meta"), s=json.dumps(row.asDict() | {"stage": stage}))

    def production(self, name: str, first: bool = False) -> int | None:
        row = registry.production_versions(self.versions(name), first).first()
        return None if row is None else row["version"]

    def delete(self, name: str, version: int) -> None:
        for what in ("data", "meta"):
            self.store.delete(self._key(name, version, what))


class Experiments:
    """Runs with parameters, metrics and artifacts under exp/<experiment>/run/<id>/..."""

    STATUSES = ("running", "completed", "failed", "killed")
    RUN = "run_id string, experiment string, started_at bigint, ended_at bigint, status string, tags array<string>, lifecycle_stage string"

    def __init__(self, store: LogStore, experiment: str):
        self.store, self.experiment, self.prefix = store, experiment, f"exp/{experiment}/run/"

    def _mine(self, pattern: str) -> DataFrame:
        return latest(self.store.log().filter(F.col("key").startswith(self.prefix) & F.col("key").contains(pattern)))

    def runs(self) -> DataFrame:
        rows = latest(self.store.log().filter(F.col("key").startswith(self.prefix) & F.col("key").endswith("/meta"))).filter("tag = 'text'")
        return rows.select(F.from_json("s", self.RUN).alias("r")).select("r.*").join(self.params().groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("params")), "run_id", "left")

    def _run(self, run_id: str) -> dict:
        got = self.store.get(f"{self.prefix}{run_id}/meta")
        if got is None:
            raise KeyNotFound(run_id)
        return json.loads(got["s"])

    def _running(self, run_id: str) -> None:
        if self._run(run_id)["status"] != "running":
            raise RunEnded(run_id)

    def start_run(self, started_at: int, tags: Sequence[str] = (), run_id: str | None = None) -> str:
        run_id = run_id or str(uuid.uuid4())
        meta = {"run_id": run_id, "experiment": self.experiment, "started_at": started_at, "ended_at": None, "status": "running", "tags": list(tags), "lifecycle_stage": "active"}
        self.store.put(f"{self.prefix}{run_id}/meta", s=json.dumps(meta))
        return run_id

    def end_run(self, run_id: str, ended_at: int, status: str = "completed") -> None:
        if status not in self.STATUSES[1:]:
            raise ValueError(f"no such end: {status}")
        self._running(run_id)
        self.store.put(f"{self.prefix}{run_id}/meta", s=json.dumps(self._run(run_id) | {"ended_at": ended_at, "status": status}))

    def mark(self, run_id: str, lifecycle_stage: str) -> None:
        """'deleted' hides a run, 'active' brings it back."""
        self.store.put(f"{self.prefix}{run_id}/meta", s=json.dumps(self._run(run_id) | {"lifecycle_stage": lifecycle_stage}))

    def log_param(self, run_id: str, name: str, value) -> None:
        self._running(run_id)
        self.store.put(f"{self.prefix}{run_id}/param/{name}", s=str(value))

    def log_metrics(self, run_id: str, name: str, values: Sequence[float], first_step: int | None = None) -> None:
        """Values at consecutive steps, from ``first_step`` or behind the last step there is."""
        self._running(run_id)
        if first_step is None:
            last = self.metrics().filter((F.col("run_id") == run_id) & (F.col("name") == name)).agg(F.max("step")).first()[0]
            first_step = 0 if last is None else last + 1
        rows = self.store.spark.createDataFrame([(f"{self.prefix}{run_id}/metric/{first_step + i:020d}/{name}", float(v)) for i, v in enumerate(values)], "key string, value double")
        self.store.append(rows.select("key", *atom(f=F.col("value"))))

    def log_artifact(self, run_id: str, name: str, data: bytes) -> None:
        self._running(run_id)
        self.store.put(f"{self.prefix}{run_id}/artifact/{name}", b=bytearray(data))

    def params(self) -> DataFrame:
        """run_id, name, value; names may hold '/'."""
        rest = F.substring(F.col("key"), F.lit(len(self.prefix) + 1), F.length("key"))
        return self._mine("/param/").select(F.substring_index(rest, "/param/", 1).alias("run_id"), F.regexp_extract(rest, "^[^/]*/param/(?s)(.*)$", 1).alias("name"), F.col("s").alias("value"))

    def metrics(self) -> DataFrame:
        """run_id, name, step, value; names may hold '/'."""
        rest = F.substring(F.col("key"), F.lit(len(self.prefix) + 1), F.length("key"))
        return self._mine("/metric/").select(
            F.substring_index(rest, "/metric/", 1).alias("run_id"), F.regexp_extract(rest, r"^[^/]*/metric/\d+/(?s)(.*)$", 1).alias("name"), F.regexp_extract(rest, r"^[^/]*/metric/(\d+)/", 1).cast("bigint").alias("step"), F.col("f").alias("value")
        )

    def artifacts(self) -> DataFrame:
        rest = F.substring(F.col("key"), F.lit(len(self.prefix) + 1), F.length("key"))
        return self._mine("/artifact/").select(F.substring_index(rest, "/artifact/", 1).alias("run_id"), F.regexp_extract(rest, "^[^/]*/artifact/(?s)(.*)$", 1).alias("name"), F.octet_length("b").alias("size_bytes"), F.col("b").alias("data"))

    def query(self, status: str | None = None, tags: Sequence[str] = (), params: Mapping[str, str] | None = None, lifecycle_stage: str = "active") -> DataFrame:
        return registry.newest_first(registry.filter_runs(registry.lifecycle(self.runs(), lifecycle_stage), self.experiment, status, tags, params))

    def compare(self, run_ids: Sequence[str]) -> DataFrame:
        return registry.compare_runs(self.runs(), self.params(), self.metrics(), run_ids)


class Transitions:
    """Reinforcement-learning records as JSON values under exp_rl/<session>/<number>."""

    RECORD = "session_id string, machine_id string, ts bigint, state array<double>, action string, reward double, next_state array<double>"
    CONTENT = ("session_id", "machine_id", "state", "action", "reward", "next_state")

    def __init__(self, store: LogStore):
        self.store = store

    def log(self, rows: DataFrame) -> int:
        """Appends records (the columns of RECORD); records whose content the store has are left out."""
        cols = [c.split()[0] for c in self.RECORD.split(", ")]
        new = rows.select(*cols).withColumn("h", registry.content_hash(self.CONTENT)).dropDuplicates(["h"])
        new = new.join(self.rows().select(registry.content_hash(self.CONTENT).alias("h")), "h", "left_anti")
        key = F.concat(F.lit("exp_rl/"), F.coalesce("session_id", F.lit("")), F.lit("/"), "h")
        return self.store.append(new.select(key.alias("key"), *atom(s=F.to_json(F.struct(*cols)))))

    def rows(self) -> DataFrame:
        return latest(self.store.log().filter(F.col("key").startswith("exp_rl/"))).select(F.from_json("s", self.RECORD).alias("r")).select("r.*")

    def sessions(self) -> DataFrame:
        return self.rows().select("session_id").filter("session_id is not null").distinct()

    def stats(self) -> DataFrame:
        return registry.session_stats(self.rows())

    def merge(self, others: Sequence[Transitions]) -> int:
        """Takes over what other stores have and this one lacks."""
        return sum(self.log(o.rows()) for o in others)


class Chats:
    """Messages by session, in the order of writing."""

    def __init__(self, store: LogStore):
        self.store = store

    def add(self, session: str, role: str, content: str) -> None:
        self.store.put(f"chat/{session}", s=json.dumps({"role": role, "content": content}))

    def messages(self, session: str | None = None) -> DataFrame:
        key = F.col("key") == f"chat/{session}" if session else F.col("key").startswith("chat/")
        rows = history(self.store.log().filter(key), include_deleted=False)
        # what was said before a session was cleared is over
        cleared = self.store.log().filter(key & (F.col("op") == "D")).groupBy("key").agg(F.max("seq").alias("__cleared"))
        live = rows.join(cleared, "key", "left").filter("__cleared is null or seq > __cleared")
        m = F.from_json("s", "role string, content string")
        return live.select(F.substring(F.col("key"), F.lit(6), F.length("key")).alias("session"), "seq", m["role"].alias("role"), m["content"].alias("content"))

    def clear(self, session: str) -> None:
        self.store.delete(f"chat/{session}")

    def sessions(self) -> DataFrame:
        return self.messages().select("session").distinct()


class Documents:
    """Documents with metadata and vectors; writing by policy 'none', 'skip' or 'overwrite'."""

    def __init__(self, store: LogStore, vectors: VectorStore | None = None):
        self.store, self.vectors = store, vectors

    def rows(self) -> DataFrame:
        live = latest(self.store.log().filter(F.col("key").startswith("doc/")))
        return live.select(F.from_json("s", "id string, content string, meta map<string,string>").alias("d")).select("d.*")

    def write(self, docs: DataFrame, policy: str = "none") -> int:
        """docs: id, content, meta[, vector]; ids are made from the content where null."""
        d = docs.withColumn("id", F.coalesce("id", F.sha2("content", 256)))
        known = self.rows().select("id")
        if policy == "none":
            if d.join(known, "id", "left_semi").limit(1).count():
                raise ValueError("duplicate document")
        elif policy == "skip":
            d = d.join(known, "id", "left_anti")
        elif policy != "overwrite":
            raise ValueError(f"no such policy: {policy}")
        n = self.store.append(d.select(F.concat(F.lit("doc/"), "id").alias("key"), *atom(s=F.to_json(F.struct("id", "content", "meta")))))
        if self.vectors is not None and "vector" in d.columns:
            self.vectors.insert_batch(d.filter("vector is not null").select(F.col("id").alias("key"), "vector"))
        return n

    def filter(self, conditions: Mapping[str, str]) -> DataFrame:
        out = self.rows()
        for k, v in conditions.items():
            out = out.filter(F.col("meta")[k] == v)
        return out

    def similar(self, query: Sequence[float], k: int, conditions: Mapping[str, str] | None = None) -> DataFrame:
        """id, content, meta, score, similarity of the closest documents that meet the conditions."""
        keep = self.filter(conditions or {})
        ids = self.vectors.rows().join(keep.select(F.col("id").alias("key")), "key", "left_semi")
        hits = knn.search(ids, list(query), k, self.vectors.metric)
        return keep.join(hits.withColumnRenamed("key", "id"), "id").withColumn("similarity", 1.0 - F.col("score")).orderBy("score", "id")

    def delete(self, id: str) -> None:
        self.store.delete(f"doc/{id}")
        if self.vectors is not None:
            self.vectors.delete(id)


class Async:
    """Calls of a store on background threads; Spark runs the jobs side by side."""

    def __init__(self, target, threads: int = 4):
        self._target, self._pool = target, ThreadPoolExecutor(threads)

    def submit(self, method: str, *args, **kwargs) -> Future:
        return self._pool.submit(getattr(self._target, method), *args, **kwargs)

    def close(self) -> None:
        self._pool.shutdown()


def register_functions(spark) -> list[str]:
    """Makes the engine's scalar functions callable from SQL by name; the names. They are SQL functions of built-in expressions."""
    dot = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    length = "aggregate({0}, 0D, (s, x) -> s + x * x)"
    norms = f"sqrt({length.format('a')} * {length.format('b')})"
    bodies = {
        "cosine_distance": f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN {norms} < 1e-10D THEN 1D ELSE 1D - {dot} / {norms} END",
        "euclidean_distance": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
        "dot_distance": f"-{dot}",
        "vector_norm": f"sqrt({length.format('a')})",
    }
    for name, body in bodies.items():
        arguments = "a ARRAY<DOUBLE>" if name == "vector_norm" else "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}")
    return list(bodies)


def sparse_bytes(vector: Column) -> Column:
    """A map term -> weight as bytes: count, then (term, weight) by ascending term, 32 bits each, little endian."""
    @F.pandas_udf("binary")
    def encode(terms: pd.Series, weights: pd.Series) -> pd.Series:
        def one(t, w) -> bytes:
            pairs = sorted(zip((int(x) for x in t), (float(x) for x in w)))
            return struct.pack("<I", len(pairs)) + b"".join(struct.pack("<If", a, b) for a, b in pairs)

        return pd.Series([one(t, w) for t, w in zip(terms, weights)])

    return encode(F.map_keys(vector), F.map_values(vector))


def read_sparse_bytes(data: bytes) -> dict[int, float]:
    (n,) = struct.unpack_from("<I", data)
    if len(data) != 4 + 8 * n:
        raise ValueError("bad length")
    return {a: b for a, b in struct.iter_unpack("<If", data[4:])}
