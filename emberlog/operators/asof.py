"""Attributes as known at event time: for every event the latest version that was valid and recorded by then.

A version is visible to an event from ``greatest(ts, written_at)`` on, so one sorted axis is enough: events and versions are
co-grouped by entity, the versions sorted by visibility, and a vectorised binary search finds the visible prefix, whose
running maximum of (ts, written_at, id) is the answer. If that one is older than the time to live, every other is too.

Skew: an entity with more than ``hot_rows`` rows (versions, and events times features) is cut into stretches of the time axis at
quantiles of its rows' times; the best version of all earlier stretches is carried into each. A stretch has about ``hot_rows`` rows, from
``hot_rows * STRETCHES`` rows on a part of ``STRETCHES`` of all rows, so what is broadcast about stretches is bounded. Stretches and entities are
dealt to groups of about ``group_rows`` rows, counted before, and so bounded however many rows there are.

Defined results
    * versions with null ts, value, written_at, id, entity, group or feature, or whose group does not define the feature: not used.
    * events with a null id, time, entity, or of an unknown group: no row. Repeated events give one row per feature.
    * ties in (ts, written_at): the greater id. Repeated versions: the same id, one row.
    * entity ids are equal if equal without outer blanks and case. A null ttl_hours is no limit.
    * empty inputs give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.times import epoch_micros
from emberlog.plans.session import cut, shuffle_tasks

NO_LIMIT = 2**62
OUTER_BLANKS = r"^[\s\u0085\u00a0\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]+|[\s\u0085\u00a0\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]+$"


def clean_entity(c: Column) -> Column:
    """An entity id without outer blanks, in lower case."""
    return F.lower(F.regexp_replace(c, OUTER_BLANKS, ""))


def latest_visible(events: pd.DataFrame, versions: pd.DataFrame) -> pd.DataFrame:
    """Per event (key, at, ttl) the id of the visible version of its key with the greatest (ts, written, id).

    events: event_id, feature, key, at, ttl; versions: key, ts, written, value_id, seen.
    """
    nothing = pd.DataFrame({"event_id": pd.Series(dtype="int64"), "feature": pd.Series(dtype=object), "value_id": pd.Series(dtype="int64")})
    if events.empty or versions.empty:
        return nothing
    codes, _ = pd.factorize(pd.concat([versions["key"], events["key"]], ignore_index=True))
    n = len(versions)
    vc, ec = codes[:n].astype(np.int64), codes[n:].astype(np.int64)
    ts, written, ids = (versions[c].to_numpy(np.int64) for c in ("ts", "written", "value_id"))
    seen, at = versions["seen"].to_numpy(np.int64), events["at"].to_numpy(np.int64)
    by_merit = np.lexsort((ids, written, ts, vc))
    merit = np.empty(n, np.int64)
    merit[by_merit] = np.arange(n)
    axis, place = np.unique(np.concatenate([seen, at]), return_inverse=True)
    v_key, e_key = vc * len(axis) + place[:n], ec * len(axis) + place[n:]
    order = np.argsort(v_key, kind="stable")
    best = np.maximum.accumulate(merit[order])  # merit grows with the code, so no reset at a new key is needed
    pos = np.searchsorted(v_key[order], e_key, side="right") - 1
    hit = by_merit[best[np.maximum(pos, 0)]]
    ok = (pos >= 0) & (vc[hit] == ec) & (at - ts[hit] <= events["ttl"].to_numpy(np.int64))
    return pd.DataFrame({"event_id": events["event_id"].to_numpy()[ok], "feature": events["feature"].to_numpy()[ok], "value_id": ids[hit[ok]]})


STRETCHES = 65_536


def split_hot(v: DataFrame, e: DataFrame, hot: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Versions and events with ``piece``: of hot entities (feature_group, entity, pieces) the stretch of the time axis, of others 0.

    most: the greatest number of pieces. The best version of every feature in the stretches before is added to each stretch, as carried.
    """
    by = ["feature_group", "entity"]
    times = v.select(*by, F.col("seen").alias("t")).unionByName(e.select(*by, F.col("at").alias("t"))).join(F.broadcast(hot), by)
    step = F.lit(most) / F.col("pieces")  # an entity's stretches end at some of the quantiles of the largest
    quantiles = times.groupBy(*by, "pieces").agg(F.percentile_approx("t", [i / most for i in range(1, most)] or [0.5], 10 * most).alias("q"))
    cuts = cut(quantiles.select(*by, "pieces", F.transform(F.filter(F.sequence(F.lit(1), F.col("pieces") - 1), lambda i: F.col("pieces") > 1), lambda i: F.element_at("q", F.floor(i * step).cast("int"))).alias("cuts")))

    def placed(df: DataFrame, at: str) -> DataFrame:
        return df.join(F.broadcast(cuts), by, "left").withColumn("piece", F.coalesce(F.size(F.filter("cuts", lambda x: x <= F.col(at))), F.lit(0)))

    v, e = placed(v, "seen"), placed(e, "at").drop("cuts", "pieces")
    best = v.filter("cuts is not null").groupBy(*by, "feature", "piece").agg(F.max(F.struct("ts", "written", "value_id", "seen")).alias("m"))
    every = best.select(*by, "feature").distinct().join(F.broadcast(cuts.select(*by, "pieces")), by).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    before = F.max("m").over(Window.partitionBy(*by, "feature").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    carried = every.join(best, [*by, "feature", "piece"], "left").withColumn("m", before).filter("m is not null")
    carried = carried.select(*by, "feature", "m.ts", "m.written", "m.value_id", "m.seen", "piece")
    return v.drop("cuts", "pieces").unionByName(carried), e


def asof_features(events: DataFrame, versions: DataFrame, groups: DataFrame, *, hot_rows: int = 50_000, group_rows: int = 400_000) -> DataFrame:
    """(event_id, feature, value_id) of every event and feature of its group that has a value known at the event's time."""
    spark = events.sparkSession
    defined = groups.select(F.col("name").alias("feature_group"), F.col("ttl_hours"), F.explode("features").alias("f")).select(
        "feature_group", F.col("f.name").alias("feature"), F.coalesce(F.col("ttl_hours").cast("bigint") * 3_600_000_000, F.lit(NO_LIMIT)).alias("ttl")
    ).filter("feature is not null").distinct()
    v = cut(  # read for the sizes, the stretches and the search
        versions.filter("ts is not null and value is not null and written_at is not null and value_id is not null")
        .select("feature_group", clean_entity(F.col("entity_id")).alias("entity"), "feature", epoch_micros("ts").alias("ts"), epoch_micros("written_at").alias("written"), F.col("value_id").cast("bigint").alias("value_id"))
        .filter("entity is not null")
        .join(defined.select("feature_group", "feature").distinct(), ["feature_group", "feature"], "left_semi")
        .withColumn("seen", F.greatest("ts", "written"))
    )
    e = cut(
        events.select(F.col("event_id").cast("bigint").alias("event_id"), "feature_group", clean_entity(F.col("entity_id")).alias("entity"), epoch_micros("event_ts").alias("at"))
        .filter("event_id is not null and entity is not null and at is not null")
        .distinct()
        .join(defined.groupBy("feature_group").agg(F.count(F.lit(1)).alias("features")), "feature_group")
    )
    counted = v.select("feature_group", "entity", F.lit(1).cast("bigint").alias("n")).unionByName(e.select("feature_group", "entity", F.col("features").alias("n")))
    sizes = cut(counted.groupBy("feature_group", "entity").agg(F.sum("n").alias("n")))
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    limit = max(hot_rows, -(-total // STRETCHES))
    hot = sizes.filter(F.col("n") > limit).select("feature_group", "entity", F.ceil(F.col("n") / limit).cast("int").alias("pieces"))  # at most STRETCHES
    v, e = split_hot(v, e.drop("features"), hot, max(1, -(-largest // limit)))
    e = e.join(defined, "feature_group")
    tasks = max(shuffle_tasks(spark), -(-total // group_rows))

    def keyed(df: DataFrame, *cols: str) -> DataFrame:
        return df.select(F.pmod(F.xxhash64("feature_group", "entity", "piece"), F.lit(tasks)).alias("task"), F.concat_ws("\x1f", "feature_group", "entity", "feature", F.col("piece").cast("string")).alias("key"), *cols)

    left = keyed(e, "event_id", "feature", "at", "ttl").groupBy("task")
    right = keyed(v, "ts", "written", "value_id", "seen").groupBy("task")
    return left.cogroup(right).applyInPandas(latest_visible, "event_id bigint, feature string, value_id bigint").distinct()


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, columns: list[str]) -> DataFrame:
    """The left rows with the right side's ``columns`` of the latest row at or before their time, nulls if there is none.

    Both sides in one union, sorted once per key; of right rows at one time the one with the greatest columns counts. Left
    rows without time get nulls. A key is one sorted sequence: for hot keys and recorded times see ``asof_features``.
    """
    held = F.struct(*columns)
    none = F.lit(None).cast(right.select(held.alias("s")).schema[0].dataType)
    a = left.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), none.alias("__right"))
    b = right.filter(F.col(right_on).isNotNull()).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(right_on).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), held.alias("__right"))
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(by))]).orderBy(F.asc_nulls_first("__t"), "__side", F.asc_nulls_first("__right")).rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("__got", F.last("__right", ignorenulls=True).over(w)).filter("__side = 1")
    return found.select("__left.*", *[F.col(f"__got.{c}").alias(c) for c in columns])
