"""Registry, runs, transitions, features and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.catalog.history import ORACLE as HISTORY
from emberlog.functions.times import epoch_micros, epoch_seconds, to_epoch_seconds
from emberlog.operators import registry as R
from emberlog.operators.asof import asof_features, asof_join, clean_entity
from emberlog.operators.ledger import clean_stage
from emberlog.sources.tables import table


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (name, version) as last dumped."""
    m = table(spark, sf_dir, "model_snapshots").select("name", "version", "snapshot_at", "loaded_at", to_epoch_seconds(F.col("created_at")).alias("created_at"), "checksum", "size_bytes", clean_stage(F.col("stage")).alias("stage"), F.try_to_number(F.col("metadata")["accuracy"], F.lit("0.999")).cast("double").alias("accuracy"))
    return R.last_rows(m, ["name", "version"], ["snapshot_at", "loaded_at"])


def model_latest(spark, d):
    return R.latest_versions(models(spark, d)).select("name", "version", "stage", "size_bytes")


def model_versions(spark, d):
    return models(spark, d).select("name", "version", "created_at", "checksum", "stage")


def model_next_version(spark, d):
    return models(spark, d).groupBy("name").agg((F.max("version") + 1).alias("next_version"))


def model_production(spark, d):
    return R.production_versions(models(spark, d))


def model_production_first(spark, d):
    return R.production_versions(models(spark, d), first=True)


def model_compare(spark, d):
    return R.compare_versions(models(spark, d))


def model_promote(spark, d):
    m = models(spark, d)
    changes = R.latest_versions(m).select("name", "version", F.lit("Production").alias("stage"))
    return R.set_stage(m.select("name", "version", "stage"), changes).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def model_checksum(spark, d):
    return table(spark, d, "documents").select("doc_id", R.checksum(F.col("text")).alias("checksum"))


def model_load_verified(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("name"), F.lit(1).alias("version"), F.encode("text", "utf-8").alias("data"))
    registry = docs.select("name", "version", R.checksum(F.col("data")).alias("checksum"))
    return R.load_verified(registry, docs).select("name", F.octet_length("data").alias("size"))


def ckpt_best(spark, d):
    return R.best_checkpoint(models(spark, d), F.col("accuracy"), ["name"])


def ckpt_best_lowest(spark, d):
    return R.best_checkpoint(models(spark, d), F.col("size_bytes").cast("double"), ["name"], highest=False)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs: experiment = segment, status by balance, two tags and a parameter."""
    c = table(spark, sf_dir, "customer")
    status = F.when(F.col("c_acctbal") < 0, "failed").when(F.col("c_acctbal") < 3000, "running").otherwise("completed")
    tags = F.array(F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")), F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd"))
    return c.select(F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("experiment"), status.alias("status"), tags.alias("tags"), F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("params"), (F.col("c_custkey") * 7919 % 100_000).alias("started_at"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as metric points: name = priority, step = order key."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("ts"))


def runs_filter(spark, d):
    hits = R.filter_runs(runs(spark, d), "BUILDING", "Completed", ["even"], {"nation": "7"})
    return R.newest_first(hits).select("run_id", "experiment", "started_at")


def runs_newest(spark, d):
    return R.newest_first(runs(spark, d)).limit(25).select("run_id", "started_at")


def runs_sort_metric_nulls_first(spark, d):
    return R.sort_by_metric(runs(spark, d), metrics(spark, d), "1-URGENT", ascending=False).select("run_id", "metric")


def runs_latest_metric(spark, d):
    return R.metric_summary(metrics(spark, d))


def runs_compare(spark, d):
    params = runs(spark, d).select("run_id", F.lit("nation").alias("name"), F.col("params")["nation"].alias("value"))
    return R.compare_runs(runs(spark, d), params, metrics(spark, d), [1, 2, 4, 5])


def runs_params(spark, d):
    params = runs(spark, d).select("run_id", F.explode("params").alias("name", "value"))
    return R.with_params(runs(spark, d).drop("params"), params).select("run_id", F.col("params")["nation"].alias("nation"), F.size("params").alias("n"))


def metric_steps(spark, d):
    return metrics(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("run_id", "name").orderBy("step")) - 1).select("run_id", "name", "place", "step", "value")


def metric_names(spark, d):
    return metrics(spark, d).select("name").distinct()


RECORD = ["session_id", "machine_id", "state", "action", "reward", "next_state"]


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "transitions")


def exp_dedup(spark, d):
    t = R.distinct_content(transitions(spark, d).select(*RECORD, "transition_id"), RECORD, "transition_id")
    return t.select("transition_id", "session_id", "action")


def exp_hash_dedup(spark, d):
    h = transitions(spark, d).select(R.content_hash(RECORD).alias("h"))
    return h.agg(F.countDistinct("h").alias("records"), F.count(F.lit(1)).alias("rows"))


def exp_merge(spark, d):
    t = transitions(spark, d).select("transition_id", *RECORD)
    merged = R.merge_sources(t.filter("transition_id % 3 = 0"), [t.filter("transition_id % 3 = 1"), t.filter("transition_id % 3 = 2")], RECORD, "transition_id")
    return merged.select("transition_id", "session_id", "action")


def exp_session_stats(spark, d):
    return R.session_stats(transitions(spark, d))


def exp_episode_stats(spark, d):
    return R.session_stats(transitions(spark, d)).filter("session_id is not null").agg(F.avg("n").alias("mean_length"), F.avg("total_reward").alias("mean_reward"), F.min("total_reward").alias("least"), F.max("total_reward").alias("most"), F.count(F.lit(1)).alias("episodes"))


def exp_chain(spark, d):
    t = R.chain_states(transitions(spark, d).dropDuplicates(["transition_id"]).filter("session_id is not null"))
    return t.select("transition_id", F.size("follow_state").alias("follow_size"))


def exp_sessions(spark, d):
    return transitions(spark, d).select("session_id").filter("session_id is not null").distinct()


def exp_replay(spark, d):
    return R.replay(transitions(spark, d).select("transition_id", "ts", "action", "reward"), 500, 64, 7).select("draw", "transition_id", "action")


def exp_replay_held(spark, d):
    """One row: how many draws there are, and whether all are of the last 500 transitions."""
    t = transitions(spark, d).select("transition_id", "ts", "action", "reward")
    last = t.orderBy(F.desc("ts"), F.desc("transition_id")).limit(500).select("transition_id").distinct()
    drawn = R.replay(t, 500, 64, 7)
    return drawn.join(last.withColumn("known", F.lit(True)), "transition_id", "left").agg(F.count(F.lit(1)).alias("draws"), F.every(F.coalesce("known", F.lit(False))).alias("from_last"))


def features_asof(spark, d):
    f = R.features_as_of(table(spark, d, "feature_values"), F.lit("2015-01-06 00:00:00").cast("timestamp_ntz"))
    return f.select("feature_group", "entity_id", "feature", epoch_micros("ts").alias("ts"), "value")


def features_latest(spark, d):
    f = R.features_as_of(table(spark, d, "feature_values"), F.lit("9999-01-01").cast("timestamp_ntz"))
    return f.select("feature_group", "entity_id", "feature", "value")


def asof_events(spark, d):
    """The last error value of the user before each purchase, as of its time."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    errors = e.filter("event_type = 'error'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("error_value"))
    return asof_join(e.filter("event_type = 'purchase'"), errors, ["user_id"], "ts", "at", ["error_value"]).select("event_id", "error_value")


NAMES = ["credit", "open_fares", "fare_mean", "charge_pct"]


def _cleaned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("entity_id", clean_entity(F.col("entity_id"))).filter("entity_id is not null")


def training_set(spark, d):
    """Every event with the latest values of its entity, whatever group they are of."""
    v = _cleaned(table(spark, d, "feature_values"))
    groups = [r["name"] for r in table(spark, d, "feature_groups").select("name").collect()]  # a table of fixed size
    e = _cleaned(table(spark, d, "label_events")).select("event_id", "feature_group", "entity_id", "label").distinct()
    return R.training_set(e, [(R.entity_features(v, groups, NAMES), "entity_id")])


def training_set_asof(spark, d):
    """Every event and feature of its group with the value that was known at the event's time, so nothing that came later."""
    e, v = table(spark, d, "label_events"), table(spark, d, "feature_values")
    known = asof_features(e, v, table(spark, d, "feature_groups"))
    values = v.filter("value is not null and ts is not null and written_at is not null").select("value_id", "value").distinct()
    labels = e.select("event_id", "label").filter("event_id is not null").distinct()
    return known.join(values, "value_id").join(labels, "event_id").select("event_id", "feature", "label", "value")


def cross_entity(spark, d):
    """Riders and bikes of one number, however their ids are spelled."""
    v = _cleaned(table(spark, d, "feature_values"))
    a = R.entity_features(v, ["rider_wallet"], ["credit"]).withColumn("n", F.regexp_extract("entity_id", r"(\d+)$", 1))
    b = R.entity_features(v, ["bike_power"], ["charge_pct"]).withColumn("n", F.regexp_extract("entity_id", r"(\d+)$", 1))
    return a.filter("n <> ''").join(b.filter("n <> ''").select("n", "charge_pct"), "n").select("n", "credit", "charge_pct")


def docs_filter_meta(spark, d):
    return R.metadata_filter(table(spark, d, "documents"), {"lang": "fr", "source": "Le Phare de Rosvel"}).select("doc_id", "n_chars")


def docs_write_policies(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    store, new = docs.filter("id % 2 = 0"), docs.filter("id % 3 = 0").withColumn("source", F.lit("new"))
    skip, over = R.write_documents(store, new, "skip"), R.write_documents(store, new, "overwrite")
    return skip.withColumn("policy", F.lit("skip")).unionByName(over.withColumn("policy", F.lit("overwrite")))


def docs_source_join(spark, d):
    """The hits of a search (the fifty longest pages) with their metadata, looked up by id."""
    docs = table(spark, d, "documents")
    hits = docs.select("doc_id", F.col("n_chars").alias("score")).filter("score is not null").orderBy(F.desc("score"), "doc_id").limit(50)
    return F.broadcast(hits).join(docs.select("doc_id", "lang", "source", "page_no"), "doc_id")


def chat_history(spark, d):
    """Pages of a source as its messages, in the order of scanning."""
    docs = table(spark, d, "documents").filter("source is not null")
    return R.chat_history(docs, "source", ["scanned_at", "doc_id"], "doc_id", ",")


def chat_sessions(spark, d):
    return table(spark, d, "documents").filter("source is not null").select("source").distinct()


def ids_and_times(spark, d):
    e = table(spark, d, "events")
    key = F.concat(F.lit("features/"), F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyyMMddHHmmss"))
    back = F.try_to_timestamp(F.split(key, "/")[2], F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    return e.select("event_id", key.alias("key"), epoch_seconds("ts").alias("seconds"), epoch_micros("ts").alias("micros"), (epoch_seconds(back) == epoch_seconds("ts")).alias("same"))


def json_props(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.lower(F.hex(F.col("props").cast("binary"))).alias("hex"))


QUERIES = {k: f for k, f in globals().items() if k.startswith(("model_", "ckpt_", "runs_", "metric_", "exp_", "features_", "asof_events", "training_", "cross_", "docs_", "chat_", "ids_", "json_")) and callable(f)}

_M = """
WITH m AS (SELECT name, version, size_bytes, checksum, CASE regexp_replace(lower(stage), '[^a-z]', '', 'g') WHEN 'development' THEN 'Development' WHEN 'staging' THEN 'Staging' WHEN 'production' THEN 'Production' WHEN 'archived' THEN 'Archived' END AS stage,
  CASE WHEN created_at < 100000000000 THEN created_at WHEN created_at < 100000000000000 THEN created_at // 1000 ELSE created_at // 1000000 END AS created_at, try_cast(metadata['accuracy'] AS DOUBLE) AS accuracy
  FROM model_snapshots QUALIFY row_number() OVER (PARTITION BY name, version ORDER BY snapshot_at DESC, loaded_at DESC) = 1)
"""
_R = """
WITH r AS (SELECT c_custkey AS run_id, c_mktsegment AS experiment, CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_acctbal < 3000 THEN 'running' ELSE 'completed' END AS status, c_nationkey, c_custkey * 7919 % 100000 AS started_at FROM customer),
p AS (SELECT o_custkey AS run_id, o_orderpriority AS name, o_orderkey AS step, o_totalprice AS value FROM orders),
s AS (SELECT run_id, name, arg_max(value, step) AS latest, min(value) AS min, max(value) AS max, avg(value) AS mean, count(*) AS n FROM p GROUP BY ALL)
"""
_SAME = "session_id, machine_id, state, action, reward, next_state"
ORACLE = {
    "model_latest": _M + "SELECT name, version, stage, size_bytes FROM m QUALIFY row_number() OVER (PARTITION BY name ORDER BY version DESC) = 1",
    "model_versions": _M + "SELECT name, version, created_at, checksum, stage FROM m",
    "model_next_version": _M + "SELECT name, max(version) + 1 AS next_version FROM m GROUP BY name",
    "model_production": _M + "SELECT name, max(version) AS version FROM m WHERE stage = 'Production' GROUP BY name",
    "model_production_first": _M + "SELECT name, min(version) AS version FROM m WHERE stage = 'Production' GROUP BY name",
    "model_compare": _M + """SELECT name, old_version, version, size_bytes - old_size AS size_change, created_at - old_created AS seconds, old_stage, stage, checksum IS DISTINCT FROM old_checksum AS changed
FROM (SELECT *, lag(version) OVER w AS old_version, lag(size_bytes) OVER w AS old_size, lag(created_at) OVER w AS old_created, lag(stage) OVER w AS old_stage, lag(checksum) OVER w AS old_checksum FROM m WINDOW w AS (PARTITION BY name ORDER BY version)) WHERE old_version IS NOT NULL""",
    "model_promote": _M + "SELECT CASE WHEN version = max(version) OVER (PARTITION BY name) THEN 'Production' ELSE stage END AS stage, 1 AS x FROM m",
    "model_checksum": "SELECT doc_id, sha256(text) AS checksum FROM documents",
    "model_load_verified": "SELECT 'm' || doc_id AS name, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL",
    "ckpt_best": _M + "SELECT name, version, accuracy AS metric FROM m WHERE accuracy IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY accuracy DESC, version) = 1",
    "ckpt_best_lowest": _M + "SELECT name, version, size_bytes::DOUBLE AS metric FROM m WHERE size_bytes IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY size_bytes, version) = 1",
    "runs_filter": _R + "SELECT run_id, experiment, started_at FROM r WHERE experiment = 'BUILDING' AND status = 'completed' AND run_id % 2 = 0 AND c_nationkey = 7",
    "runs_newest": _R + "SELECT run_id, started_at FROM r ORDER BY started_at DESC, run_id LIMIT 25",
    "runs_sort_metric_nulls_first": _R + "SELECT run_id, latest AS metric FROM r LEFT JOIN (SELECT * FROM s WHERE name = '1-URGENT') USING (run_id)",
    "runs_latest_metric": _R + "SELECT * FROM s",
    "runs_params": _R + "SELECT run_id, c_nationkey::VARCHAR AS nation, 1 AS n FROM r",
    "metric_steps": _R + "SELECT run_id, name, row_number() OVER (PARTITION BY run_id, name ORDER BY step) - 1 AS place, step, value FROM p",
    "metric_names": _R + "SELECT DISTINCT name FROM p",
    "exp_dedup": f"SELECT min(transition_id) AS transition_id, session_id, action FROM transitions GROUP BY {_SAME}",
    "exp_hash_dedup": f"SELECT (SELECT count(*) FROM (SELECT DISTINCT {_SAME} FROM transitions)) AS records, count(*) AS rows FROM transitions",
    "exp_merge": f"SELECT arg_min(transition_id, (transition_id % 3, transition_id)) AS transition_id, session_id, action FROM transitions GROUP BY {_SAME}",
    "exp_session_stats": "SELECT session_id, count(*) AS n, sum(reward) FILTER (NOT isnan(reward)) AS total_reward, avg(reward) FILTER (NOT isnan(reward)) AS mean_reward FROM transitions GROUP BY session_id",
    "exp_episode_stats": "SELECT avg(n) AS mean_length, avg(t) AS mean_reward, min(t) AS least, max(t) AS most, count(*) AS episodes FROM (SELECT count(*) AS n, sum(reward) FILTER (NOT isnan(reward)) AS t FROM transitions WHERE session_id IS NOT NULL GROUP BY session_id)",
    "exp_sessions": "SELECT DISTINCT session_id FROM transitions WHERE session_id IS NOT NULL",
    "features_asof": "SELECT feature_group, entity_id, feature, epoch_us(ts) AS ts, value FROM feature_values WHERE ts <= TIMESTAMP '2015-01-06' QUALIFY row_number() OVER (PARTITION BY feature_group, entity_id, feature ORDER BY feature_values.ts DESC, value_id DESC) = 1",
    "features_latest": "SELECT feature_group, entity_id, feature, value FROM feature_values WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feature_group, entity_id, feature ORDER BY ts DESC, value_id DESC) = 1",
    "asof_events": "SELECT p.event_id, e.value AS error_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e ON p.user_id = e.user_id AND p.ts >= e.ts",
    "docs_filter_meta": "SELECT doc_id, n_chars FROM documents WHERE lang = 'fr' AND source = 'Le Phare de Rosvel'",
    "docs_write_policies": """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'new' END AS source, 'skip' AS policy FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0
UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END, 'overwrite' FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""",
    "docs_source_join": "SELECT doc_id, n_chars AS score, lang, source, page_no FROM documents WHERE n_chars IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 50",
    "exp_chain": """SELECT transition_id, len(lead(state) OVER (PARTITION BY session_id ORDER BY ts NULLS FIRST, transition_id)) AS follow_size
 FROM (SELECT * FROM transitions WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY transition_id ORDER BY ts) = 1)""",
    "exp_replay_held": "SELECT 64::BIGINT AS draws, true AS from_last",
    "chat_history": "SELECT source, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY scanned_at NULLS FIRST, doc_id) AS history FROM documents WHERE source IS NOT NULL GROUP BY source",
    "chat_sessions": "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL",
    "ids_and_times": "SELECT event_id, 'features/' || user_id || '/' || strftime(ts, '%Y%m%d%H%M%S') AS key, epoch_us(ts) // 1000000 AS seconds, epoch_us(ts) AS micros, true AS same FROM events",
    "json_props": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, lower(hex(encode(props))) AS hex FROM events",
}
ORACLE["model_promote"] = "SELECT stage, count(*) AS n FROM (" + ORACLE["model_promote"].strip() + ") GROUP BY stage"
_CLEAN = """WITH c AS (SELECT * REPLACE (lower(trim(entity_id)) AS entity_id) FROM feature_values WHERE entity_id IS NOT NULL),
last AS (SELECT feature_group, entity_id, feature, value FROM c WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feature_group, entity_id, feature ORDER BY ts DESC, value_id DESC) = 1)
"""
ORACLE["training_set"] = _CLEAN + ", f AS (SELECT entity_id, " + ", ".join(f"coalesce(max(value) FILTER (feature = '{n}'), 0) AS {n}" for n in NAMES) + """ FROM last WHERE feature_group IN (SELECT name FROM feature_groups) GROUP BY entity_id)
SELECT e.entity_id, event_id, e.feature_group, label, """ + ", ".join(f"coalesce({n}, 0) AS {n}" for n in NAMES) + """ FROM (SELECT DISTINCT event_id, feature_group, lower(trim(entity_id)) AS entity_id, label FROM label_events WHERE entity_id IS NOT NULL) e LEFT JOIN f USING (entity_id)"""
ORACLE["training_set_asof"] = "WITH k AS (" + HISTORY["p3_found"] + """), v AS (SELECT DISTINCT value_id, value FROM feature_values WHERE value IS NOT NULL AND ts IS NOT NULL AND written_at IS NOT NULL)
SELECT k.event_id, k.feature, l.label, v.value FROM k JOIN v USING (value_id) JOIN (SELECT DISTINCT event_id, label FROM label_events WHERE event_id IS NOT NULL) l ON l.event_id = k.event_id"""
ORACLE["cross_entity"] = _CLEAN + r""", a AS (SELECT entity_id, regexp_extract(entity_id, '(\d+)$', 1) AS n, coalesce(max(value) FILTER (feature = 'credit'), 0) AS credit FROM last WHERE feature_group = 'rider_wallet' GROUP BY entity_id),
b AS (SELECT entity_id, regexp_extract(entity_id, '(\d+)$', 1) AS n, coalesce(max(value) FILTER (feature = 'charge_pct'), 0) AS charge_pct FROM last WHERE feature_group = 'bike_power' GROUP BY entity_id)
SELECT n, credit, charge_pct FROM a JOIN b USING (n) WHERE n <> ''"""
ORACLE["runs_compare"] = _R + """, w AS (SELECT * FROM r WHERE run_id IN (1, 2, 4, 5)),
a AS (SELECT 'param' AS kind, 'nation' AS name, run_id, c_nationkey::VARCHAR AS value FROM w UNION ALL
 SELECT kind, name, run_id, round(v, 6)::VARCHAR FROM (SELECT name, run_id, unnest(['latest', 'min', 'max', 'mean']) AS kind, unnest([latest, min, max, mean]) AS v FROM s WHERE run_id IN (SELECT run_id FROM w)))
SELECT g.kind, g.name, w.run_id, a.value FROM (SELECT DISTINCT kind, name FROM a) g CROSS JOIN w LEFT JOIN a ON a.kind = g.kind AND a.name = g.name AND a.run_id = w.run_id"""
