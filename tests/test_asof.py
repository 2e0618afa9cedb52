from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from emberlog.operators.asof import asof_features

T0 = datetime(2024, 1, 1)
VALUES = "value_id bigint, feature_group string, entity_id string, feature string, ts timestamp_ntz, value double, written_at timestamp_ntz"
EVENTS = "event_id bigint, feature_group string, entity_id string, event_ts timestamp_ntz, label int, arrived_at timestamp_ntz"
GROUPS = "name string, entity string, ttl_hours int, description string, features array<struct<name:string,dtype:string,description:string>>"


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def run(spark, values, events, groups=(("g", 5, ("f", "h")),), **options):
    v = spark.createDataFrame([(i, g, e, f, at(t), x, at(w)) for i, g, e, f, t, x, w in values], VALUES)
    e = spark.createDataFrame([(i, g, n, at(t), 1, None) for i, g, n, t in events], EVENTS)
    g = spark.createDataFrame([(n, None, ttl, None, [(f, None, None) for f in fs]) for n, ttl, fs in groups], GROUPS)
    return sorted(tuple(r) for r in asof_features(e, v, g, **options).collect())


def test_known_in_time(spark):
    values = [(1, "g", "a", "f", 1, 1.0, 1), (2, "g", " A ", "f", 3, 1.0, 9), (3, "g", "a", "f", 2, 1.0, 2), (4, "g", "a", "h", 1, 1.0, 1), (5, "g", "a", "z", 1, 1.0, 1)]
    got = run(spark, values, [(10, "g", "A", 4), (11, "g", "a", 7), (12, "g", "b", 4), (13, "x", "a", 4)])
    assert got == [(10, "f", 3), (10, "h", 4), (11, "f", 3)]


def test_ties_nulls_repeats_empty(spark):
    values = [(1, "g", "a", "f", 1, 1.0, 2), (2, "g", "a", "f", 1, 1.0, 2), (2, "g", "a", "f", 1, 1.0, 2), (3, "g", "a", "f", None, 1.0, 1), (4, "g", "a", "f", 2, None, 2), (5, None, None, None, 1, 1.0, 1)]
    events = [(1, "g", "a", 3), (1, "g", "a", 3), (2, "g", None, 3), (3, "g", "a", None), (None, "g", "a", 3)]
    assert run(spark, values, events) == [(1, "f", 2)]
    assert run(spark, [], events) == [] and run(spark, values, []) == [] and run(spark, values, events, ()) == []


def test_no_limit_and_exact_limit(spark):
    values = [(1, "g", "a", "f", 0, 1.0, 0)]
    assert run(spark, values, [(1, "g", "a", 5), (2, "g", "a", 6)]) == [(1, "f", 1)]
    assert run(spark, values, [(1, "g", "a", 9000)], (("g", None, ("f",)),)) == [(1, "f", 1)]


@pytest.mark.parametrize("hot", [10**9, 20])
def test_equals_brute_force_also_when_hot_entities_are_split(spark, hot):
    rnd = random.Random(5)
    values = [(i, "g", rnd.choice("aaaaaabc"), rnd.choice("fh"), rnd.randint(0, 60), 1.0, 0) for i in range(400)]
    values = [(*v[:6], v[4] + rnd.choice([-3, 0, 0, 1, 8])) for v in values]
    events = [(i, "g", rnd.choice("aabcd"), rnd.randint(0, 70)) for i in range(150)]
    want = []
    for i, g, n, t in events:
        for f in "fh":
            ok = [(v[4], v[6], v[0]) for v in values if v[2] == n and v[3] == f and v[4] <= t and t - v[4] <= 5 and v[6] <= t]
            if ok:
                want.append((i, f, max(ok)[2]))
    assert run(spark, values, events, hot_rows=hot) == sorted(want)


def test_asof_join(spark):
    from emberlog.operators.asof import asof_join

    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "a", None), (5, None, 5)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 5, 2.0), ("a", 3, 9.0), ("b", 10, 1.0), (None, 1, 7.0), ("a", None, 8.0)], "k string, t int, x double")
    got = {r.id: r.x for r in asof_join(left, right, ["k"], "t", "t", ["x"]).collect()}
    assert got == {1: 2.0, 2: None, 3: None, 4: None, 5: 7.0}
    assert asof_join(left.limit(0), right, ["k"], "t", "t", ["x"]).count() == 0


def test_one_version_and_very_many_events(spark):
    events = [(i, "g", "a" if i % 3 else "b", i % 500) for i in range(2000)]
    want = sorted((i, "f", 1) for i, _, n, t in events if n == "a" and t >= 7)
    assert run(spark, [(1, "g", "a", "f", 7, 1.0, 7)], events, (("g", None, ("f",)),), hot_rows=50) == want
    assert run(spark, [(1, "g", "a", "f", 7, 1.0, 7)], events, (("g", None, ("f",)),), hot_rows=50, group_rows=100) == want


def test_stretches_are_bounded(spark):
    from pyspark.sql import functions as F

    from emberlog.operators.asof import split_hot

    rnd = random.Random(7)
    v = spark.createDataFrame([("g", "a", f"f{i % 5}", t, t, i, t) for i in range(600) for t in [rnd.randint(0, 10_000)]], "feature_group string, entity string, feature string, ts bigint, written bigint, value_id bigint, seen bigint")
    e = spark.createDataFrame([(i, "g", rnd.choice("aab"), rnd.randint(0, 10_000)) for i in range(3000)], "event_id bigint, feature_group string, entity string, at bigint")
    hot = spark.createDataFrame([("g", "a", 26), ("g", "b", 10)], "feature_group string, entity string, pieces int")
    v2, e2 = split_hot(v, e, hot, 26)
    rows = v2.select("entity", "piece").unionByName(e2.select("entity", "piece")).groupBy("entity", "piece").count().collect()
    assert {r.entity: r.piece for r in sorted(rows, key=lambda r: r.piece)} == {"a": 25, "b": 9}
    assert max(r["count"] for r in rows) <= 200  # a hundred, the carried versions, and ties at the stretches' ends
    assert e2.count() == 3000 and v2.filter(F.col("piece") == 0).count() < 60
