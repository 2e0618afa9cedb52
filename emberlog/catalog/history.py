"""Queries p1 (history of model versions) and p3 (features as known at event time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.times import epoch_micros
from emberlog.operators.asof import asof_features
from emberlog.operators.ledger import version_history, version_ledger
from emberlog.plans.session import cut
from emberlog.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unbroken run of a version in one state: valid_from and valid_to in epoch seconds, valid_to 0 if it still holds."""
    second = F.lit(1_000_000)
    return version_history(table(spark, sf_dir, "model_snapshots")).select(
        "name", "version", "stage", "created_at", F.floor(F.col("valid_from") / second).alias("valid_from"), F.coalesce(F.floor(F.col("valid_to") / second), F.lit(0)).cast("bigint").alias("valid_to")
    )


def p1_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bitemporal ledger, superseded beliefs included; times in microseconds."""
    return version_ledger(table(spark, sf_dir, "model_snapshots"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value row of each event and feature that the store knew at the event's time and that had not run out."""
    return asof_features(table(spark, sf_dir, "label_events"), table(spark, sf_dir, "feature_values"), table(spark, sf_dir, "feature_groups"))


def p1_ledger_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: what must hold of the ledger. Beliefs of one version never overlap in valid and recorded time, a superseded belief ends after it
    began, and what is believed now covers exactly the dumps that have the version."""
    ledger = cut(p1_ledger(spark, sf_dir))
    key = ["name", "version"]
    a, b = ledger.alias("a"), ledger.alias("b")
    end = lambda t, c: F.coalesce(F.col(f"{t}.{c}"), F.lit(2**62))
    meet = (F.col("a.name") == F.col("b.name")) & (F.col("a.version") == F.col("b.version")) & (F.col("a.valid_from") == F.col("b.valid_from")) & (F.col("a.recorded_from") < F.col("b.recorded_from"))
    overlaps = a.join(b, meet & (end("a", "recorded_to") > F.col("b.recorded_from"))).agg(F.count(F.lit(1))).scalar()  # at most one row a dump and load
    empty = ledger.filter("recorded_to <= recorded_from or valid_to <= valid_from").agg(F.count(F.lit(1))).scalar()
    dumps = table(spark, sf_dir, "model_snapshots").filter("name is not null and version is not null").select(*key, epoch_micros("snapshot_at").alias("at")).filter("at is not null").distinct()
    now = ledger.filter("recorded_to is null").select(*key, "valid_from", F.coalesce("valid_to", F.lit(2**62)).alias("valid_to"))
    covered = dumps.join(now, key).filter("at >= valid_from and at < valid_to").select(*key, "at")
    return spark.range(1).select((overlaps == 0).alias("no_overlap"), (empty == 0).alias("no_empty"), (covered.agg(F.count(F.lit(1))).scalar() == dumps.agg(F.count(F.lit(1))).scalar()).alias("all_dumps_once"))


QUERIES = {"p1_found": p1_found, "p1_ledger": p1_ledger, "p1_ledger_held": p1_ledger_held, "p3_found": p3_found}

_STATES = """
WITH rows AS (
  SELECT name, version, epoch_us(snapshot_at) AS s, epoch_us(loaded_at) AS l,
    CASE regexp_replace(lower(stage), '[^a-z]', '', 'g') WHEN 'development' THEN 'Development' WHEN 'staging' THEN 'Staging'
      WHEN 'production' THEN 'Production' WHEN 'archived' THEN 'Archived' END AS stage,
    CASE WHEN created_at < 100000000000 THEN created_at WHEN created_at < 100000000000000 THEN created_at // 1000
      ELSE created_at // 1000000 END AS created_at
  FROM model_snapshots WHERE name IS NOT NULL AND version IS NOT NULL),
one AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY name, version, s ORDER BY l DESC, stage DESC NULLS LAST, created_at DESC NULLS LAST) = 1),
dumps AS (SELECT s, lead(s) OVER (ORDER BY s) AS e, row_number() OVER (ORDER BY s) AS i FROM (SELECT DISTINCT s FROM rows)),
filled AS (
  SELECT name, version, s, e, i, last_value(stage IGNORE NULLS) OVER w AS stage, last_value(created_at IGNORE NULLS) OVER w AS created_at
  FROM one JOIN dumps USING (s) WINDOW w AS (PARTITION BY name, version ORDER BY s)),
marked AS (
  SELECT *, CASE WHEN i = 1 + lag(i) OVER w AND stage IS NOT DISTINCT FROM lag(stage) OVER w AND created_at IS NOT DISTINCT FROM lag(created_at) OVER w THEN 0 ELSE 1 END AS fresh
  FROM filled WINDOW w AS (PARTITION BY name, version ORDER BY s)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY name, version ORDER BY s) AS run FROM marked)
"""

ORACLE = {
    "p1_ledger_held": "SELECT true AS no_overlap, true AS no_empty, true AS all_dumps_once",
    "p1_found": _STATES
    + """SELECT name, version, any_value(stage) AS stage, any_value(created_at) AS created_at, min(s) // 1000000 AS valid_from,
  CASE WHEN bool_or(e IS NULL) THEN 0 ELSE max(e) // 1000000 END AS valid_to FROM runs GROUP BY name, version, run""",
    "p3_found": """
WITH g AS (SELECT name AS feature_group, ttl_hours, f.name AS feature FROM (SELECT name, ttl_hours, unnest(features) AS f FROM feature_groups)),
v AS (SELECT feature_group, lower(trim(entity_id)) AS entity, feature, ts, written_at, value_id FROM feature_values WHERE ts IS NOT NULL AND value IS NOT NULL AND written_at IS NOT NULL),
e AS (SELECT DISTINCT event_id, feature_group, lower(trim(entity_id)) AS entity, event_ts FROM label_events WHERE entity_id IS NOT NULL)
SELECT DISTINCT event_id, feature, value_id FROM (
  SELECT e.event_id, g.feature, v.value_id, row_number() OVER (PARTITION BY e.event_id, e.event_ts, g.feature ORDER BY v.ts DESC, v.written_at DESC, v.value_id DESC) AS r
  FROM e JOIN g USING (feature_group) JOIN v ON v.feature_group = e.feature_group AND v.feature = g.feature AND v.entity = e.entity
   AND v.ts <= e.event_ts AND v.written_at <= e.event_ts AND (g.ttl_hours IS NULL OR epoch_us(e.event_ts) - epoch_us(v.ts) <= g.ttl_hours * 3600000000))
WHERE r = 1""",
}
