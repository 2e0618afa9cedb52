"""Exact search over dense vectors, hot and cold together, and a planner; the indexes are in ``ann``.

The corpus is never collected or sent around. Queries are; their number is checked against ``MAX_QUERIES`` first, beyond
which the batch search goes block by block. Every task keeps k rows per query, so what is shuffled is k x queries x tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.errors import DimensionMismatch
from emberlog.functions.distance import distance, distance_matrix, metric_of

MAX_QUERIES = 4096


def first_write(vectors: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """One row per key, the first written (stores that skip known keys)."""
    cols = [c for c in vectors.columns if c != key]
    return vectors.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("r")).select(key, "r.*")


def last_write(vectors: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """One row per key, the last written."""
    cols = [c for c in vectors.columns if c != key]
    return vectors.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*")


def check_dims(vectors: DataFrame, dims: int, vector: str = "vector") -> DataFrame:
    """Fails the job on a vector of another length."""
    message = F.concat(F.lit(f"a vector has {dims} dimensions here, not "), F.size(vector).cast("string"))
    return vectors.withColumn(vector, F.when(F.size(vector) == dims, F.col(vector)).otherwise(F.raise_error(message)))


def search(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", key: str = "key", vector: str = "vector", round_to: int | None = None) -> DataFrame:
    """key, score of the k closest vectors, ascending (ties: smaller key): a projection and a top-k, without a shuffle of the corpus."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = distance(metric, F.col(vector), q)
    if round_to is not None:
        score = F.round(score, round_to)
    return vectors.select(key, score.alias("score")).orderBy("score", key).limit(k)


def _query_matrix(queries: DataFrame, qid: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    got = queries.select(qid, F.col(vector).cast("array<double>").alias("v")).limit(MAX_QUERIES + 1).toArrow()
    if got.num_rows > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries: use search_blocks")
    if not got.num_rows:
        return np.zeros(0), np.zeros((0, 0))
    lengths = {len(v) for v in got.column("v").to_pylist()}
    if len(lengths) > 1:
        raise DimensionMismatch(f"queries of different length: {sorted(lengths)}")
    return np.array(got.column(qid).to_pylist()), np.array(got.column("v").to_pylist())


def _best(kind: str, qids: np.ndarray, q: np.ndarray, k: int, metric: str, not_self: bool):
    """A mapInArrow function: (key, vector) -> the k closest of its rows for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_pylist()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if x.shape[1] != q.shape[1]:
                raise DimensionMismatch(f"vectors of {x.shape[1]}, queries of {q.shape[1]} dimensions")
            d = np.round(distance_matrix(metric, q, x), 9)
            for i in range(len(q)):
                row = d[i]
                near = np.argpartition(row, k)[: k + 1] if len(row) > k + 1 else np.arange(len(row))
                edge = row[near].max()
                near = np.flatnonzero(row <= edge)
                held[i] = sorted([*held.get(i, []), *((row[j], keys[j]) for j in near if not (not_self and keys[j] == qids[i]))])[:k]
        out = [(qids[i], key, s) for i, rows in held.items() for s, key in rows]
        columns = list(zip(*out)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]).cast(pa.type_for_alias(kind)) if out else pa.array([], pa.type_for_alias(kind)), pa.array(columns[1]).cast(pa.type_for_alias(kind)) if out else pa.array([], pa.type_for_alias(kind)), pa.array(columns[2], pa.float64())], names=["qid", "key", "score"])

    return run


def search_batch(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "key", vector: str = "vector", qid: str = "qid", not_self: bool = False) -> DataFrame:
    """qid, key, score, rank: exact top-k of every query, by Arrow batches and matrix products.

    Up to MAX_QUERIES queries go to every task; more are held against the corpus block by block (``search_blocks``).
    """
    kind = dict(vectors.dtypes)[key]
    if queries.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        near = search_blocks(vectors, queries, k + not_self, metric, key, vector, qid)
        return again_ranked(near.filter("qid <> key"), k) if not_self else near
    qids, q = _query_matrix(queries, qid, vector)
    alias = {"bigint": "int64", "int": "int32", "string": "string"}[kind]
    schema = f"qid {kind}, key {kind}, score double"
    if not len(q):
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    found = vectors.select(key, F.col(vector)).filter(F.col(vector).isNotNull()).mapInArrow(_best(alias, qids, q, k, metric_of(metric), not_self), schema)
    return again_ranked(found, k)


def again_ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query of (qid, key, score), with ``rank`` from 1 (ties: smaller key)."""
    w = Window.partitionBy("qid").orderBy("score", "key")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_blocks(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "key", vector: str = "vector", qid: str = "qid", block: int = MAX_QUERIES, data_blocks: int | None = None) -> DataFrame:
    """As ``search_batch`` for any number of queries: blocks of queries against blocks of the corpus.

    Every pair of blocks is one task with bounded sides; a vector is sent once per block of queries.
    """
    from emberlog.plans.session import shuffle_tasks

    n = queries.count()
    q_blocks = max(1, -(-n // block))
    d_blocks = data_blocks or shuffle_tasks(vectors.sparkSession)
    kind = dict(vectors.dtypes)[key]
    q = queries.select(F.pmod(F.xxhash64(qid), F.lit(q_blocks)).cast("int").alias("__q"), F.explode(F.sequence(F.lit(0), F.lit(d_blocks - 1))).alias("__d"), F.col(qid).alias("qid"), F.col(vector).cast("array<double>").alias("v"))
    x = vectors.filter(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(d_blocks)).cast("int").alias("__d"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("__q"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["qid", "key", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (left.schema.field("qid").type, right.schema.field("key").type, pa.float64()))})
        a, b = (np.array(t.column("v").to_pylist(), np.float64) for t in (left, right))
        keys = np.array(right.column("key").to_pylist(), dtype=object)
        rank = np.argsort(np.argsort(keys, kind="stable"), kind="stable")
        d = np.round(distance_matrix(metric, a, b), 9)
        top = np.lexsort((np.broadcast_to(rank, d.shape), d), axis=1)[:, :k]
        rows = np.repeat(np.arange(len(a)), top.shape[1])
        return pa.table({"qid": left.column("qid").take(pa.array(rows)), "key": right.column("key").take(pa.array(top.ravel())), "score": pa.array(d[rows, top.ravel()])})

    found = q.groupBy("__q", "__d").cogroup(x.groupBy("__q", "__d")).applyInArrow(best, f"qid {dict(queries.dtypes)[qid]}, key {kind}, score double")
    return again_ranked(found, k)


def merge_tiers(hot: DataFrame, cold: DataFrame, k: int) -> DataFrame:
    """key, score, source of the k best of two result sets, each key once with its lower score (ties: hot)."""
    both = hot.select("key", "score", F.lit("hot").alias("source")).unionByName(cold.select("key", "score", F.lit("cold").alias("source")))
    best = both.groupBy("key").agg(F.min_by(F.struct("score", "source"), F.struct("score", (F.col("source") == "cold").alias("c"))).alias("r"))
    return best.select("key", "r.score", "r.source").orderBy("score", "key").limit(k)


def promote(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """The cold tier after promotion: rows of hot are added where cold lacks the key; hot itself stays as it is."""
    return cold.unionByName(hot.join(cold.select("key"), "key", "left_anti").select(*cold.columns))


def centroids(vectors: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """group, pos (from 1), mean: the element-wise mean of the vectors of each group."""
    cells = vectors.select(group, F.posexplode(vector).alias("pos", "x"))
    return cells.groupBy(group, (F.col("pos") + 1).alias("pos")).agg(F.avg(F.col("x").cast("double")).alias("mean"))


def plan_search(rows: int, k: int, threshold: int = 10_000, index: object | None = None) -> str:
    """The access path for a corpus of ``rows`` vectors: 'exact' below the threshold or without an index, else 'index'."""
    return "exact" if rows < threshold or index is None else "index"


def recall_at(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """qid, recall: the share of a query's true top-k that was found."""
    t = truth.filter(F.col("rank") <= k).select("qid", "key")
    hit = t.join(found.filter(F.col("rank") <= k).select("qid", "key", F.lit(1.0).alias("hit")), ["qid", "key"], "left")
    return hit.groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def retrieval_quality(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """recall_at_k and mrr over queries: results (qid, key, rank), truth (qid, key)."""
    hits = truth.join(results.filter(F.col("rank") <= k), ["qid", "key"], "left")
    per_query = hits.groupBy("qid").agg(F.avg(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)).alias("r"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("rr"))
    return per_query.agg(F.avg("r").alias("recall_at_k"), F.avg("rr").alias("mrr"), F.count(F.lit(1)).alias("queries"))
