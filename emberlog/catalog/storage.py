"""Queries that write stores into the shared scratch folder and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.atoms import atom
from emberlog.operators import log as L
from emberlog.operators import stores as S
from emberlog.plans.session import scratch
from emberlog.sources import rawlog
from emberlog.sources.tables import table


def store_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances put into a log, a seventh deleted, a fifth put again, the log compacted: what lives."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("key"), "c_acctbal")
    store = L.LogStore(spark, scratch(spark, "store"), config=L.StoreConfig(delta=True))
    store.append(c.select("key", *atom(f=F.col("c_acctbal").cast("double")), "c_custkey"), [F.col("c_custkey")])
    store.append(c.filter("c_custkey % 7 = 0").select("key", F.lit("D").alias("op"), *atom()))
    store.append(c.filter("c_custkey % 5 = 0").select("key", *atom(i=F.col("c_custkey"))))
    store.compact()
    return L.latest(store.log()).select("key", "tag", "f", "i")


def store_deleted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys left after those of a pattern were deleted."""
    n = table(spark, sf_dir, "nation").select(F.concat("n_regionkey", F.lit("/"), "n_name").alias("key"), "n_nationkey")
    store = L.LogStore(spark, scratch(spark, "store"), config=L.StoreConfig(sync=False))
    store.append(n.select("key", *atom(i=F.col("n_nationkey").cast("bigint"))))
    store.delete_matching("[12]/*")
    store.put("9/NEW", s="kept")
    store.delete("0/KENYA")
    store.flush()
    return L.keys(store.log())


def store_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten closest of a vector store after every tenth vector was written again, turned round."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("vector"), "vec_id")
    v = S.VectorStore(L.LogStore(spark, scratch(spark, "vectors")), 64)
    v.insert_batch(e.select("key", "vector"))
    v.insert_batch(e.filter("vec_id % 10 = 5").select("key", F.reverse("vector").alias("vector")))
    q = e.filter("vec_id = 0").first()["vector"]
    return v.search([float(x) for x in q], 10).select("key", F.round("score", 6).alias("score"))


def store_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and postings of a sparse store after some were deleted by key and by id."""
    p = table(spark, sf_dir, "sparse_postings").filter("doc_id is not null and term_id is not null and weight > 0 and not isnan(weight)").select("doc_id", "key", "term_id", "weight").distinct()
    s = S.SparseStore(spark, scratch(spark, "sparse"))
    s.index_batch(p)
    newest = s.documents().agg(F.max("doc_id")).first()[0]
    s.delete_by_id(newest)
    s.delete("no such key")
    return s.documents().agg(F.count(F.lit(1)).alias("documents"), F.count("key").alias("keyed"), F.max("doc_id").alias("newest"))


def store_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry with three versions saved, one promoted, one deleted."""
    m = S.Models(L.LogStore(spark, scratch(spark, "models")))
    for data in (b"one", b"three", b"eleven"):
        m.save("net", data)
    m.set_stage("net", 2, "Production")
    m.delete("net", 3)
    assert m.load("net") == b"three"
    return m.versions().select("name", "version", "stage", "size_bytes", "checksum")


def store_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with parameters and metrics, one of them ended: steps of the metrics."""
    x = S.Experiments(L.LogStore(spark, scratch(spark, "runs"), config=L.StoreConfig(sync=True)), "e")
    for run in ("a", "b"):
        x.start_run(1, ["t"], run)
        x.log_param(run, "rate", 0.5)
        x.log_metrics(run, "loss", [3.0, 2.0])
    x.log_metrics("a", "loss", [1.0])
    x.end_run("a", 9)
    ended = x.query(status="completed").select("run_id", "ended_at", F.col("params")["rate"].alias("rate"))
    return ended.join(x.metrics(), "run_id").select("run_id", "ended_at", "rate", "name", "step", "value")


def rawlog_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as a binary log with damaged bytes between them, read by the recovering reader."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # a table of fixed size
    data = b""
    for r in rows:
        data += rawlog.encode_entry(f"nation/{r['n_nationkey']}", "text", r["n_name"]) + (b"\xff\xfe\x00damaged\xff" if r["n_nationkey"] % 4 == 0 else b"")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark, 'raw')}/log.bin")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(data)
    out.close()
    return rawlog.read_raw_logs(spark, path.getParent().toString()).select("key", "op", "tag", "s")


QUERIES = {k: f for k, f in globals().items() if k.startswith(("store_", "rawlog_")) and callable(f)}

ORACLE = {
    "store_latest": """SELECT 'customer/' || c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN 'int' ELSE 'float' END AS tag, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal::DOUBLE END AS f,
 CASE WHEN c_custkey % 5 = 0 THEN c_custkey END AS i FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 5 = 0""",
    "store_deleted_keys": "SELECT n_regionkey || '/' || n_name AS key FROM nation WHERE n_regionkey NOT IN (1, 2) AND n_regionkey || '/' || n_name <> '0/KENYA' UNION ALL SELECT '9/NEW'",
    "store_vectors": """WITH v AS (SELECT vec_id, vec_id::VARCHAR AS key, CASE WHEN vec_id % 10 = 5 THEN list_reverse(CAST(embedding AS DOUBLE[])) ELSE CAST(embedding AS DOUBLE[]) END AS x FROM embeddings),
q AS (SELECT x AS y FROM v WHERE vec_id = 0) SELECT key, round(1 - list_inner_product(x, y) / sqrt(list_inner_product(x, x) * list_inner_product(y, y)), 6) AS score FROM v, q ORDER BY score, key LIMIT 10""",
    "store_sparse": """WITH p AS (SELECT DISTINCT doc_id, key FROM sparse_postings WHERE doc_id IS NOT NULL AND term_id IS NOT NULL AND weight > 0 AND NOT isnan(weight)),
d AS (SELECT max(doc_id) AS doc_id, key FROM p WHERE key IS NOT NULL GROUP BY key UNION ALL SELECT doc_id, key FROM p WHERE key IS NULL), x AS (SELECT * FROM d WHERE doc_id < (SELECT max(doc_id) FROM d))
SELECT count(*) AS documents, count(key) AS keyed, max(doc_id) AS newest FROM x""",
    "store_models": "SELECT 'net' AS name, v AS version, s AS stage, octet_length(encode(x))::BIGINT AS size_bytes, sha256(x) AS checksum FROM (VALUES (1, 'Development', 'one'), (2, 'Production', 'three')) t(v, s, x)",
    "store_runs": "SELECT 'a' AS run_id, 9::BIGINT AS ended_at, '0.5' AS rate, 'loss' AS name, s::BIGINT AS step, v::DOUBLE AS value FROM (VALUES (0, 3), (1, 2), (2, 1)) t(s, v)",
    "rawlog_recovered": "SELECT 'nation/' || n_nationkey AS key, 'P' AS op, 'text' AS tag, n_name AS s FROM nation",
}
