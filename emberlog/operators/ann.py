"""Approximate search over dense vectors by stored indexes: inverted lists and hyperplane hashing.

Both are fitted once (lists: on a bounded sample), written to a folder, opened again from it, and take further vectors by appending.
Searching reads what the queries open and nothing else: lists are partitions of the stored table, buckets are found by a join with the
queries' probes. Scores are exact, only which rows are seen is approximate; ``scanned`` tells how large that share is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.errors import DimensionMismatch, IndexNotReady
from emberlog.functions.distance import distance_matrix, metric_of
from emberlog.operators.knn import MAX_QUERIES, again_ranked

SEED = 42


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n < 1e-10, 1.0, n)


def as_matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) % max(1, len(column)) or dims is not None and len(flat) != dims * len(column):
        raise DimensionMismatch(f"vectors of {dims} dimensions expected")
    return flat.reshape(len(column), -1).astype(np.float64)


def queries_of(queries: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of (qid, vector) in blocks of MAX_QUERIES, so that what a task is sent stays bounded."""
    rows = queries.select("qid", F.col("vector").cast("array<double>").alias("vector"))
    if queries.limit(MAX_QUERIES + 1).count() <= MAX_QUERIES:
        blocks = [rows]
    else:
        n = -(-rows.count() // (MAX_QUERIES // 2))
        blocks = [rows.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)]
    for b in blocks:
        got = b.toArrow()
        if got.num_rows:
            yield got.column("qid").combine_chunks(), as_matrix(got.column("vector"))


def together(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lloyd(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means, begun with every n-th row; an empty cluster keeps its centre."""
    c = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        order = np.argsort(at, kind="stable")
        present, first = np.unique(at[order], return_index=True)
        c[present] = np.add.reduceat(x[order], first, axis=0)
        c = unit(c)
    return c


@dataclass
class ListIndex:
    """Inverted lists: hierarchical k-means on at most ``sample`` rows, every row in the list of its nearest leaf.

    The number of lists follows the corpus: six times the square root of its rows, at most ``most``, over ``levels`` levels. A
    search opens the ``nprobe`` nearest lists of each query (by default a thirty-second part of all, at least four, and as many as hold 4 k rows).
    """

    levels: int = 3
    sample: int = 20_000
    most: int = 4096
    centres: np.ndarray | None = None
    rows: int = 0
    metric: str = "cosine"
    path: str | None = field(default=None, repr=False)

    def fit(self, vectors: DataFrame) -> ListIndex:
        """Fits the lists to (key, vector) rows."""
        self.rows = vectors.count()
        share = F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(min(1_000_000, 1 + 1_200_000 * self.sample / max(1, self.rows)))
        got = vectors.filter(share).select("key", "vector").orderBy(F.xxhash64("key"), "key").limit(self.sample).toArrow()
        if not got.num_rows:
            raise IndexNotReady("no vectors to fit lists to")
        x = unit(as_matrix(got.column("vector")))
        wanted = min(self.most, max(1, int(6 * math.sqrt(self.rows))))
        branching = max(1, round(wanted ** (1 / self.levels)))
        centres = lloyd(x, branching)
        for _ in range(self.levels - 1):
            at = (x @ centres.T).argmax(axis=1)
            centres = np.concatenate([lloyd(x[at == c], branching) for c in range(len(centres)) if (at == c).any()])
        self.centres = centres
        return self

    def _fitted(self) -> np.ndarray:
        if self.centres is None:
            raise IndexNotReady("fit the index first")
        return self.centres

    def default_probes(self, k: int) -> int:
        lists = len(self._fitted())
        return max(4, round(lists / 32), math.ceil(4 * k * lists / max(1, self.rows)))

    def place(self, vectors: DataFrame) -> DataFrame:
        """key, vector, list of (key, vector) rows."""
        held = vectors.sparkSession.sparkContext.broadcast(self._fitted())  # at most ``most`` rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = unit(as_matrix(b.column(1), held.value.shape[1]))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array((x @ held.value.T).argmax(axis=1).astype(np.int32))], names=["key", "vector", "list"])

        rows = vectors.select("key", "vector").filter("vector is not null")
        kinds = dict(rows.dtypes)
        return rows.mapInArrow(run, f"key {kinds['key']}, vector {kinds['vector']}, list int")

    def save(self, vectors: DataFrame, path: str) -> ListIndex:
        """Writes the lists of (key, vector) rows to a folder, one partition a list, and the centres beside them."""
        spark = vectors.sparkSession
        centres = [(i, c.tolist(), self.metric, self.rows) for i, c in enumerate(self._fitted())]
        spark.createDataFrame(centres, "list int, centre array<double>, metric string, rows bigint").write.mode("overwrite").parquet(f"{path}/centres")
        self.place(vectors).repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
        self.path = path
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str, dims: int | None = None) -> ListIndex:
        """The index of a folder; another number of dimensions than ``dims`` is an error."""
        try:
            got = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # at most ``most`` rows
        except Exception as e:
            raise IndexNotReady(f"no index in {path}") from e
        centres = np.array([r["centre"] for r in got])
        if dims is not None and centres.shape[1] != dims:
            raise DimensionMismatch(f"the index has {centres.shape[1]} dimensions, not {dims}")
        return cls(centres=centres, rows=got[0]["rows"], metric=got[0]["metric"], path=path)

    def insert(self, vectors: DataFrame) -> None:
        """Appends (key, vector) rows to the stored lists."""
        if self.path is None:
            raise IndexNotReady("save the index first")
        self.place(vectors).write.mode("append").partitionBy("list").parquet(f"{self.path}/rows")

    def stored(self, spark: SparkSession) -> DataFrame:
        if self.path is None:
            raise IndexNotReady("save the index first")
        return spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")

    def probes(self, q: np.ndarray, k: int, nprobe: int | None = None) -> np.ndarray:
        """The nearest lists of each query, nearest first."""
        return np.argsort(-(unit(q) @ self._fitted().T), axis=1, kind="stable")[:, : nprobe or self.default_probes(k)]

    def search(self, placed: DataFrame, queries: DataFrame, k: int, nprobe: int | None = None) -> DataFrame:
        """qid, key, score, rank of (qid, vector) queries. placed: ``stored`` or ``place``d rows; only the opened lists of it are read."""
        kinds = dict(placed.dtypes)
        schema = f"qid {dict(queries.dtypes)['qid']}, key {kinds['key']}, score double"
        parts = [self._search_block(placed, qids, q, k, nprobe, schema) for qids, q in queries_of(queries)]
        return again_ranked(together(parts, placed.sparkSession, schema), k)

    def _search_block(self, placed: DataFrame, qids: pa.Array, q: np.ndarray, k: int, nprobe: int | None, schema: str) -> DataFrame:
        opened = self.probes(q, k, nprobe)
        asks = {int(c): np.flatnonzero((opened == c).any(axis=1)) for c in np.unique(opened)}
        held = placed.sparkSession.sparkContext.broadcast((qids, q, asks))
        metric = metric_of(self.metric)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q, asks = held.value
            for b in batches:
                x, lists = as_matrix(b.column(1), q.shape[1]), b.column(2).to_numpy()
                for c in np.unique(lists).tolist():
                    who, at = asks.get(c), np.flatnonzero(lists == c)
                    if who is None:
                        continue
                    d = np.round(distance_matrix(metric, q[who], x[at]), 9)
                    if len(at) > k:  # ties at the k-th are kept, the last ranking orders them by key
                        i, j = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
                    else:
                        i, j = (y.ravel() for y in np.indices(d.shape))
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(who[i])), b.column(0).take(pa.array(at[j])), pa.array(d[i, j])], names=["qid", "key", "score"])

        rows = placed.filter(F.col("list").isin([int(c) for c in asks])).select("key", "vector", "list")
        return rows.mapInArrow(run, schema)

    def sizes(self, placed: DataFrame) -> DataFrame:
        """list, n."""
        return placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"))

    def scanned(self, placed: DataFrame, queries: DataFrame, k: int, nprobe: int | None = None) -> float:
        """The share of all (query, row) pairs that a search measures."""
        n = np.zeros(len(self._fitted()))
        for r in self.sizes(placed).collect():  # one row a list
            n[r["list"]] = r["n"]
        shares = [n[self.probes(q, k, nprobe)].sum(axis=1) / max(1.0, n.sum()) for _, q in queries_of(queries)]
        return float(np.concatenate(shares).mean()) if shares else 0.0


@dataclass
class HashIndex:
    """Hyperplane hashing: ``tables`` tables of ``bits`` seeded planes; a query also probes the buckets of its least certain bits."""

    tables: int = 20
    bits: int = 16
    probed: int = 8
    metric: str = "cosine"
    path: str | None = field(default=None, repr=False)

    # The presets (tables, bits, probes).
    PRESETS = {"small": (8, 8, 2), "large": (20, 12, 4), "high_recall": (20, 4, 4), "fast_search": (4, 8, 1)}

    @classmethod
    def preset(cls, name: str) -> HashIndex:
        return cls(*cls.PRESETS[name])

    @classmethod
    def sized(cls, rows: int, tables: int = 20, probed: int = 8) -> HashIndex:
        """Bits that grow with the corpus, so that a bucket's rows don't: six more than it takes to number the rows."""
        return cls(tables, min(62, round(math.log2(max(2, rows))) + 6), probed)

    def planes(self, dims: int) -> np.ndarray:
        return unit(np.random.Generator(np.random.PCG64(SEED)).normal(size=(self.tables * self.bits, dims)))

    def codes(self, x: np.ndarray, probed: int = 1) -> np.ndarray:
        """(row, table, probe): the bucket, then those with one and with two of the least certain bits turned."""
        d = (x @ self.planes(x.shape[1]).T).reshape(len(x), self.tables, self.bits)
        code = ((d > 0).astype(np.int64) << np.arange(self.bits)).sum(axis=2)
        turns = np.int64(1) << np.argsort(np.abs(d), axis=2, kind="stable")
        probe = [code, *(code ^ turns[:, :, i] for i in range(self.bits))][:probed]
        for i in range(self.bits):
            for j in range(i + 1, self.bits):
                if len(probe) < probed:
                    probe.append(code ^ turns[:, :, i] ^ turns[:, :, j])
        return np.stack(probe, axis=2)

    def buckets(self, vectors: DataFrame) -> DataFrame:
        """tbl, bucket, key of (key, vector) rows: one row a table."""
        index = HashIndex(self.tables, self.bits, self.probed)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    code = index.codes(as_matrix(b.column(1)))[:, :, 0]
                    tbl = np.tile(np.arange(index.tables, dtype=np.int32), b.num_rows)
                    yield pa.RecordBatch.from_arrays([pa.array(tbl), pa.array(code.ravel()), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), index.tables)))], names=["tbl", "bucket", "key"])

        rows = vectors.select("key", "vector").filter("vector is not null")
        return rows.mapInArrow(run, f"tbl int, bucket bigint, key {dict(rows.dtypes)['key']}")

    def save(self, vectors: DataFrame, path: str) -> HashIndex:
        """Writes buckets and vectors of (key, vector) rows to a folder."""
        spark = vectors.sparkSession
        spark.createDataFrame([(self.tables, self.bits, self.probed, self.metric)], "tables int, bits int, probed int, metric string").write.mode("overwrite").parquet(f"{path}/index")
        self.path = path
        for mode, name, rows in (("overwrite", "buckets", self.buckets(vectors)), ("overwrite", "rows", vectors.select("key", "vector"))):
            rows.write.mode(mode).parquet(f"{path}/{name}")
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HashIndex:
        try:
            r = spark.read.parquet(f"{path}/index").first()
        except Exception as e:
            raise IndexNotReady(f"no index in {path}") from e
        return cls(r["tables"], r["bits"], r["probed"], r["metric"], path)

    def insert(self, vectors: DataFrame) -> None:
        if self.path is None:
            raise IndexNotReady("save the index first")
        self.buckets(vectors).write.mode("append").parquet(f"{self.path}/buckets")
        vectors.select("key", "vector").write.mode("append").parquet(f"{self.path}/rows")

    def stored(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Buckets and rows of the index's folder."""
        if self.path is None:
            raise IndexNotReady("save the index first")
        return spark.read.parquet(f"{self.path}/buckets"), spark.read.parquet(f"{self.path}/rows")

    def candidates(self, buckets: DataFrame, qids: pa.Array, q: np.ndarray) -> DataFrame:
        """key, asks: the rows in a bucket that some of the queries (by place) probe, with those queries."""
        code = self.codes(q, self.probed)
        n, tables, probed = code.shape
        place, tbl, _ = (x.ravel() for x in np.indices(code.shape))
        probes = pa.table({"tbl": pa.array(tbl.astype(np.int32)), "bucket": pa.array(code.ravel()), "place": pa.array(place.astype(np.int32))})
        asked = F.broadcast(buckets.sparkSession.createDataFrame(probes))  # MAX_QUERIES x tables x probes rows at most
        return buckets.join(asked, ["tbl", "bucket"]).groupBy("key").agg(F.collect_set("place").alias("asks"))  # at most MAX_QUERIES a row

    def search(self, buckets: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """qid, key, score, rank of (qid, vector) queries: rows that share a probed bucket in some table, measured exactly."""
        kinds = dict(vectors.dtypes)
        schema = f"qid {dict(queries.dtypes)['qid']}, key {kinds['key']}, score double"
        metric, parts = metric_of(self.metric), []
        for qids, q in queries_of(queries):
            held = vectors.sparkSession.sparkContext.broadcast((qids, q))

            def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                qids, q = held.value
                for b in batches:
                    x, asks = as_matrix(b.column(1), q.shape[1]), b.column(2)
                    times = np.diff(asks.offsets.to_numpy())
                    row, who = np.repeat(np.arange(b.num_rows), times), asks.flatten().to_numpy()
                    d = np.concatenate([np.zeros(0), *(pair_distances(metric, q[who[i : i + 8192]], x[row[i : i + 8192]]) for i in range(0, len(row), 8192))])
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(who)), b.column(0).take(pa.array(row)), pa.array(np.round(d, 9))], names=["qid", "key", "score"])

            asked = vectors.select("key", "vector").join(self.candidates(buckets, qids, q), "key")
            parts.append(asked.mapInArrow(run, schema))
        return again_ranked(together(parts, vectors.sparkSession, schema), k)

    def scanned(self, buckets: DataFrame, rows: int, queries: DataFrame) -> float:
        """The share of all (query, row) pairs that a search measures."""
        pairs = asked = 0
        for qids, q in queries_of(queries):
            asked += len(qids)
            pairs += self.candidates(buckets, qids, q).agg(F.coalesce(F.sum(F.size("asks")), F.lit(0))).first()[0]
        return pairs / max(1, asked * rows)

    def stats(self, buckets: DataFrame) -> DataFrame:
        """tbl, buckets, largest, mean: how the rows fill each table."""
        sizes = buckets.groupBy("tbl", "bucket").agg(F.count(F.lit(1)).alias("n"))
        return sizes.groupBy("tbl").agg(F.count(F.lit(1)).alias("buckets"), F.max("n").alias("largest"), F.avg("n").alias("mean"))


def pair_distances(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a to the rows of b, one by one."""
    p = np.einsum("ij,ij->i", a, b)
    if metric == "dot":
        return -p
    if metric == "euclidean":
        return np.sqrt(((a - b) ** 2).sum(axis=1))
    length = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return np.where(length < 1e-10, 1.0, 1.0 - p / np.where(length < 1e-10, 1.0, length))
