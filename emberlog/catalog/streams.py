"""Streaming queries: run over all files there are, then compared with the batch result."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import knn as K
from emberlog.operators.anomaly import level_model
from emberlog.sources.tables import table
from emberlog.streaming import streams as S


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stream_files(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)


def _closed(spark: SparkSession, sf_dir: str, build, columns: list[str], name: str) -> DataFrame:
    """A windowed stream of the events in append mode, closed by an event a year after the last one."""
    e = table(spark, sf_dir, "events")
    end = e.agg(F.max("ts").alias("ts")).withColumn("ts", F.expr("ts + INTERVAL 366 DAYS"))
    closing = end.select(*[F.col("ts") if c == "ts" else F.lit(None).cast(kind).alias(c) for c, kind in e.dtypes if c in columns])
    return S.run_closed(_events(spark, sf_dir).select(*closing.columns), lambda df: build(S.event_time(df)), closing, name)


def stream_tumbling(spark, d):
    return _closed(spark, d, lambda e: S.tumbling(e, "1 hour", ["event_type"]), ["ts", "event_type", "value"], "tumbling")


def stream_sliding(spark, d):
    return _closed(spark, d, lambda e: S.tumbling(e, "6 hours", ["event_type"], slide="2 hours"), ["ts", "event_type", "value"], "sliding")


def stream_session(spark, d):
    return _closed(spark, d, lambda e: S.sessions(e, "1 day", ["user_id"]), ["ts", "user_id"], "session")


def stream_late_rows(spark, d):
    """Events arrive in two files, the second with rows older than the watermark: these are dropped, once their windows are closed."""
    e, out = table(spark, d, "events").select("ts", "event_type", "value"), S.shared_folder(spark, "late")
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    middle = first + (last - first) / 2
    e.filter(F.col("ts") >= F.lit(middle)).coalesce(1).write.parquet(f"{out}/in/early")
    build = lambda df: S.tumbling(S.event_time(df, delay="2 hours"), "1 hour", ["event_type"])
    stream = build(spark.readStream.schema(e.schema).parquet(f"{out}/in/*"))
    S.run_to_end(stream, folder=f"{out}/run")
    e.filter(F.col("ts") < F.lit(middle)).coalesce(1).write.parquet(f"{out}/in/late")
    return S.run_to_end(stream, folder=f"{out}/run").agg(F.coalesce(F.sum((F.col("start") < int((middle - datetime(1970, 1, 1)).total_seconds()) // 3600 * 3600).cast("int")), F.lit(0)).alias("late_windows"), (F.count(F.lit(1)) > 0).alias("windows_given"))


def stream_dedup(spark, d):
    """Events of the same user, type and time, each once."""
    e = S.event_time(_events(spark, d), delay="1 day").select("user_id", "event_type", "ts")
    return S.run_to_end(S.deduplicated(e, ["user_id", "event_type", "ts"]), "append", "dedup").select("user_id", "event_type", F.unix_micros("ts").alias("micros"))


def stream_anomaly(spark, d):
    """The score of the last eight values of a user at each event, by the level model."""
    model = level_model(table(spark, d, "events"), 8, "value")
    a = S.anomalies(_events(spark, d), model, "user_id", "event_id", "value")
    return S.run_to_end(a, "append", "anomaly").filter("ready").select("user_id", "event_id", "score")


def stream_restarted(spark, d):
    """Step counters of a stream that is stopped after half of the files and begun again from its checkpoint."""
    e, out = table(spark, d, "events").select("event_id", "user_id"), S.shared_folder(spark, "restart")
    half = e.agg(F.max("event_id")).first()[0] // 2
    stream = S.step_counter(spark.readStream.schema(e.schema).parquet(f"{out}/in/*"), "user_id", "event_id")
    for n, part in enumerate(("event_id <= {}", "event_id > {}")):
        e.filter(part.format(half)).write.parquet(f"{out}/in/{n}")
        rows = S.run_to_end(stream, folder=f"{out}/run")
    return rows


def stream_rolling_state(spark, d):
    r = S.rolling_state(_events(spark, d), 20, "user_id", "event_id", "value")
    return S.run_to_end(r, "append", "rolling").filter("ready").select("user_id", "event_id", "mean", "low", "high")


def stream_latest_upsert(spark, d):
    return S.upsert_latest(_events(spark, d), "user_id", "event_id", ["value"]).select("user_id", "event_id", "value")


def stream_step_counter(spark, d):
    return S.run_to_end(S.step_counter(_events(spark, d), "user_id", "event_id"), "append", "steps")


def stream_hot_tier(spark, d):
    """Vectors arrive in the hot tier, and a search sees them beside the cold one."""
    e = table(spark, d, "embeddings")
    hot = S.ingest_hot(S.stream_files(spark, f"{d}/embeddings.parquet", e.schema).filter("vec_id % 2 = 0"), ["vec_id", "embedding"])
    q = e.filter("vec_id = 0").first()["embedding"]
    parts = [K.search(t.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), q, 10, round_to=6) for t in (hot, e.filter("vec_id % 2 = 1"))]
    return K.merge_tiers(*parts, 10)


QUERIES = {k: f for k, f in globals().items() if k.startswith("stream_") and callable(f)}

ORACLE = {
    "stream_hot_tier": """WITH v AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), q AS (SELECT x AS y FROM v WHERE key = 0)
SELECT key, round(1 - list_inner_product(x, y) / sqrt(list_inner_product(x, x) * list_inner_product(y, y)), 6) AS score, CASE WHEN key % 2 = 0 THEN 'hot' ELSE 'cold' END AS source FROM v, q ORDER BY score, key LIMIT 10""",
    "stream_tumbling": "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": """SELECT s // 1000000 AS start, event_type, count(*) AS n, sum(value) AS total FROM (
 SELECT event_type, value, epoch_us(ts) // 7200000000 * 7200000000 - unnest([0, 1, 2]) * 7200000000 AS s FROM events) GROUP BY 1, 2""",
    "stream_session": """SELECT epoch_us(min(ts)) AS start, user_id, count(*) AS n FROM (
 SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s""",
    "stream_dedup": "SELECT DISTINCT user_id, event_type, epoch_us(ts) AS micros FROM events",
    "stream_late_rows": "SELECT 0::BIGINT AS late_windows, true AS windows_given",  # what must hold
    "stream_anomaly": """SELECT user_id, event_id, v AS score FROM (SELECT user_id, event_id, count(*) OVER w AS n, var_pop((value - m) / (s + 1e-8)) OVER w AS v
 FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 7 PRECEDING)) WHERE n = 8""",
    "stream_restarted": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step FROM events",
    "stream_rolling_state": """SELECT user_id, event_id, mean, low, high FROM (SELECT user_id, event_id, count(*) OVER w AS n, avg(value) OVER w AS mean, min(value) OVER w AS low, max(value) OVER w AS high FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 19 PRECEDING)) WHERE n = 20""",
    "stream_latest_upsert": "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "stream_step_counter": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step FROM events",
}
