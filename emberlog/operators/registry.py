"""Versioned models, runs with parameters and metrics, checkpoints, transitions, features, documents and messages.

Each is a table of append-only rows; changing something appends a row, and the views take the last one per identity.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.errors import ChecksumMismatch, RunEnded


def last_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every identity by ``order`` (one combined aggregation)."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*keys, "r.*")


# --- models -------------------------------------------------------------------------------------------------------------


def checksum(data: Column) -> Column:
    return F.sha2(data, 256)


def save_models(models: DataFrame, new: DataFrame, created_at: Column) -> DataFrame:
    """Registry rows for new (name, data, metadata): the next version of each name, in the order of their checksums, stage Development."""
    top = models.groupBy("name").agg(F.max("version").alias("top"))
    digest = new.withColumn("checksum", checksum(F.col("data")))
    place = F.row_number().over(Window.partitionBy("name").orderBy("checksum"))
    return digest.withColumn("n", place).join(top, "name", "left").select(
        "name", (F.coalesce("top", F.lit(0)) + F.col("n")).cast("int").alias("version"), created_at.alias("created_at"), "checksum", F.octet_length("data").cast("bigint").alias("size_bytes"), F.lit("Development").alias("stage"), "metadata"
    )


def latest_versions(models: DataFrame) -> DataFrame:
    return last_rows(models, ["name"], ["version"])


def production_versions(models: DataFrame, first: bool = False) -> DataFrame:
    """Of each name the highest (or, if ``first``, the lowest) version in stage Production."""
    live = models.filter("stage = 'Production'")
    pick = F.min("version") if first else F.max("version")
    return live.groupBy("name").agg(pick.alias("version"))


def set_stage(models: DataFrame, changes: DataFrame) -> DataFrame:
    """The registry after (name, version, stage) changes; several versions may be in Production."""
    c = changes.select("name", "version", F.col("stage").alias("__stage"))
    return models.join(c, ["name", "version"], "left").withColumn("stage", F.coalesce("__stage", "stage")).drop("__stage")


def compare_versions(models: DataFrame) -> DataFrame:
    """Every version against the one before it: size and time differences, stages, whether the content changed."""
    w = Window.partitionBy("name").orderBy("version")
    prev = {c: F.lag(c).over(w) for c in ("version", "size_bytes", "created_at", "stage", "checksum")}
    out = models.withColumns({f"old_{c}": x for c, x in prev.items()}).filter("old_version is not null")
    return out.select(
        "name", "old_version", "version", (F.col("size_bytes") - F.col("old_size_bytes")).alias("size_change"), (F.col("created_at") - F.col("old_created_at")).alias("seconds"), "old_stage", "stage", (~F.col("checksum").eqNullSafe(F.col("old_checksum"))).alias("changed")
    )


def load_verified(models: DataFrame, blobs: DataFrame) -> DataFrame:
    """Registry rows with their data; a row whose data has another checksum fails the job."""
    message = F.concat(F.lit(f"{ChecksumMismatch.__name__}: "), "name", F.lit(" "), F.col("version").cast("string"))
    joined = models.join(blobs.select("name", "version", "data"), ["name", "version"])
    return joined.withColumn("data", F.when(checksum(F.col("data")) == F.col("checksum"), F.col("data")).otherwise(F.raise_error(message)))


def best_checkpoint(checkpoints: DataFrame, metric: Column, keys: Sequence[str], highest: bool = True, order: str = "version") -> DataFrame:
    """Of each group the checkpoint with the best metric; without the metric: ignored; ties: the first."""
    value = checkpoints.withColumn("metric", metric).filter(F.col("metric").isNotNull() & ~F.isnan("metric"))
    merit = F.struct(F.col("metric") if highest else -F.col("metric"), -F.col(order))
    return value.groupBy(*keys).agg(F.max_by(F.struct(order, "metric"), merit).alias("r")).select(*keys, "r.*")


# --- runs ---------------------------------------------------------------------------------------------------------------


def filter_runs(runs: DataFrame, experiment: str | None = None, status: str | None = None, tags: Sequence[str] = (), params: Mapping[str, str] | None = None) -> DataFrame:
    """Runs that meet all conditions: every tag, every parameter equal as text."""
    out = runs
    if experiment is not None:
        out = out.filter(F.col("experiment") == experiment)
    if status is not None:
        out = out.filter(F.lower("status") == status.lower())
    for t in tags:
        out = out.filter(F.array_contains("tags", t))
    for k, v in (params or {}).items():
        out = out.filter(F.col("params")[k] == str(v))
    return out


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "run_id")


def sort_by_metric(runs: DataFrame, metrics: DataFrame, name: str, ascending: bool) -> DataFrame:
    """Runs by the latest value of a metric; runs without it come first in either direction."""
    last = metrics.filter(F.col("name") == name).groupBy("run_id").agg(F.max_by("value", "step").alias("metric"))
    order = F.asc_nulls_first("metric") if ascending else F.desc_nulls_first("metric")
    return runs.join(last, "run_id", "left").orderBy(order, "run_id")


def metric_summary(metrics: DataFrame) -> DataFrame:
    """run_id, name: latest, min, max, mean, n of every metric of every run."""
    return metrics.groupBy("run_id", "name").agg(F.max_by("value", "step").alias("latest"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def compare_runs(runs: DataFrame, params: DataFrame, metrics: DataFrame, run_ids: Sequence) -> DataFrame:
    """kind ('param' or a metric statistic), name, run_id, value as text of the given runs; absent values are null."""
    wanted = runs.filter(F.col("run_id").isin(list(run_ids))).select("run_id")
    p = params.join(wanted, "run_id", "left_semi").select(F.lit("param").alias("kind"), "name", "run_id", F.col("value").cast("string").alias("value"))
    m = metric_summary(metrics.join(wanted, "run_id", "left_semi"))
    stats = m.select("name", "run_id", F.explode(F.create_map(*[x for s in ("latest", "min", "max", "mean") for x in (F.lit(s), F.round(s, 6).cast("string"))])).alias("kind", "value"))
    rows = p.unionByName(stats.select("kind", "name", "run_id", "value"))
    ids = F.array(*[F.lit(r) for r in run_ids])
    grid = rows.select("kind", "name").distinct().select("kind", "name", F.explode(ids).alias("run_id")).join(wanted, "run_id", "left_semi")
    return grid.join(rows, ["kind", "name", "run_id"], "left")


def with_params(runs: DataFrame, params: DataFrame) -> DataFrame:
    """Runs with their parameters as a map; empty names and values are dropped."""
    p = params.filter("name <> '' and value is not null and value <> ''")
    m = p.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("params"))
    return runs.join(m, "run_id", "left").withColumn("params", F.coalesce("params", F.create_map().cast("map<string,string>")))


def check_running(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Points of running runs; a point of a run that has ended fails the job."""
    ended = runs.filter("lower(status) <> 'running'").select("run_id", F.lit(True).alias("__ended"))
    message = F.concat(F.lit(f"{RunEnded.__name__}: "), F.col("run_id").cast("string"))
    out = points.join(ended, "run_id", "left")
    return out.withColumn("run_id", F.when(F.col("__ended").isNull(), F.col("run_id")).otherwise(F.raise_error(message))).drop("__ended")


def lifecycle(rows: DataFrame, view: str = "active") -> DataFrame:
    """'active', 'deleted' or 'all' rows by lifecycle_stage."""
    return rows if view == "all" else rows.filter(F.col("lifecycle_stage") == view)


# --- transitions --------------------------------------------------------------------------------------------------------


def content_hash(columns: Sequence[str], digits: int = 16) -> Column:
    """A hash of the columns' content (times and metadata are not given): nulls, NaN and empty arrays are told apart."""
    return F.substring(F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(c) for c in sorted(columns)])), 256), 1, digits)


def distinct_content(rows: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal content the first by ``order``."""
    cols = [c for c in rows.columns if c not in columns]
    return rows.groupBy(*columns).agg(F.min_by(F.struct(*cols), order).alias("r")).select(*columns, "r.*")


def merge_sources(destination: DataFrame, sources: Sequence[DataFrame], columns: Sequence[str], order: str) -> DataFrame:
    """Union of stores without repeated content: rows of the destination stay, of the rest the first source's first row."""
    both = destination.withColumn("__src", F.lit(0))
    for n, s in enumerate(sources, 1):
        both = both.unionByName(s.withColumn("__src", F.lit(n)))
    cols = [c for c in destination.columns if c not in columns]
    merged = both.groupBy(*columns).agg(F.min_by(F.struct(*cols), F.struct("__src", order)).alias("r"))
    return merged.select(*columns, "r.*").select(*destination.columns)


def session_stats(rows: DataFrame, session: str = "session_id") -> DataFrame:
    """n, total and mean reward per session (NaN and null rewards are not counted in the sums)."""
    r = F.when(~F.isnan("reward"), F.col("reward"))
    return rows.groupBy(session).agg(F.count(F.lit(1)).alias("n"), F.sum(r).alias("total_reward"), F.avg(r).alias("mean_reward"))


def chain_states(rows: DataFrame, session: str = "session_id", order: Sequence[str] = ("ts", "transition_id")) -> DataFrame:
    """Adds follow_state: the state of the next transition of the session."""
    return rows.withColumn("follow_state", F.lead("state").over(Window.partitionBy(session).orderBy(*order)))


def replay(rows: DataFrame, capacity: int, batch: int, seed: int, order: Sequence[str] = ("ts", "transition_id")) -> DataFrame:
    """``batch`` draws with replacement from the last ``capacity`` rows (a ring buffer), seeded: draw, and the row's columns."""
    last = rows.orderBy(*[F.desc(c) for c in order]).limit(capacity)
    slots = last.withColumn("__slot", F.row_number().over(Window.orderBy(*order)) - 1)  # at most ``capacity`` rows
    held = slots.agg(F.count(F.lit(1))).scalar()
    draws = rows.sparkSession.range(batch).select(F.col("id").alias("draw"), held.alias("__n")).filter("__n > 0")
    picked = draws.withColumn("__slot", F.pmod(F.xxhash64(F.lit(seed), "draw"), F.col("__n")).cast("int"))
    return picked.join(slots, "__slot").drop("__slot", "__n")


# --- features, documents, messages --------------------------------------------------------------------------------------


def features_as_of(values: DataFrame, as_of: Column) -> DataFrame:
    """The value with the greatest ts <= as_of of every group, entity and feature ('latest' pointers without ts are ignored)."""
    known = values.filter(F.col("ts").isNotNull() & (F.col("ts") <= as_of))
    return known.groupBy("feature_group", "entity_id", "feature").agg(F.max_by(F.struct("ts", "value"), F.struct("ts", "value_id")).alias("r")).select("feature_group", "entity_id", "feature", "r.*")


def entity_features(values: DataFrame, groups: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per entity with the latest value of every named feature as a column, missing ones 0."""
    last = features_as_of(values.filter(F.col("feature_group").isin(list(groups))), F.lit("9999-12-31").cast("timestamp_ntz"))
    wide = last.groupBy("entity_id").agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features])
    return wide.fillna(0.0, list(features))


def training_set(events: DataFrame, sides: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Events with the columns of each (features, join column); events without features get 0."""
    out = events
    for df, on in sides:
        cols = [c for c in df.columns if c != on]
        out = out.join(df, on, "left").fillna(0.0, cols)
    return out


def metadata_filter(docs: DataFrame, conditions: Mapping[str, str]) -> DataFrame:
    """Documents whose columns equal all given values; a missing value equals nothing."""
    out = docs
    for k, v in conditions.items():
        out = out.filter(F.col(k) == v)
    return out


def write_documents(store: DataFrame, new: DataFrame, policy: str = "overwrite", id: str = "id") -> DataFrame:
    """The store after writing documents by policy: 'none' (a known id fails the job), 'skip' or 'overwrite'."""
    if policy == "skip":
        return store.unionByName(new.join(store.select(id), id, "left_anti"))
    if policy == "overwrite":
        return store.join(new.select(id), id, "left_anti").unionByName(new)
    if policy != "none":
        raise ValueError(f"no such policy: {policy}")
    known = store.select(F.col(id), F.lit(True).alias("__known"))
    checked = new.join(known, id, "left")
    failed = F.raise_error(F.concat(F.lit("duplicate document: "), F.col(id).cast("string"))).cast(dict(new.dtypes)[id])
    return store.unionByName(checked.withColumn(id, F.when(F.col("__known").isNull(), F.col(id)).otherwise(failed)).drop("__known"))


def chat_history(messages: DataFrame, session: str, order: Sequence[str], content: str, separator: str = "\n") -> DataFrame:
    """session, n, history: the session's messages in order, joined."""
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(content).cast("string").alias("__said"))))
    return messages.groupBy(session).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(items, lambda m: m["__said"]), separator).alias("history"))
