from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.operators import ledger as L

SCHEMA = "snapshot_at timestamp_ntz, name string, version int, created_at bigint, checksum string, size_bytes bigint, stage string, metadata map<string,string>, loaded_at timestamp_ntz"
T0 = datetime(2024, 1, 1)


def rows(*given_):
    out = []
    for day, name, version, created, stage, load in given_:
        at = T0 + timedelta(days=day)
        out.append((at, name, version, created, None, None, stage, {}, at + timedelta(hours=load)))
    return out


def history(spark, given_):
    h = L.version_history(spark.createDataFrame(rows(*given_), SCHEMA))
    day = 86_400_000_000
    base = int((T0 - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    return sorted(((r.name, r.version, r.stage, r.created_at, (r.valid_from - base) // day, None if r.valid_to is None else (r.valid_to - base) // day) for r in h.collect()), key=repr)


def test_runs_gaps_and_nulls(spark):
    got = history(spark, [(0, "a", 1, 100, "staging ", 1), (1, "a", 1, None, None, 1), (2, "b", 1, 5, "Production", 1), (3, "a", 1, 100_000, "STAGING", 1), (4, "a", 1, 100, "Archived", 1)])
    assert got == [("a", 1, "Archived", 100, 4, None), ("a", 1, "Staging", 100, 0, 2), ("a", 1, "Staging", 100_000, 3, 4), ("b", 1, "Production", 5, 2, 3)]


def test_late_rows_supersede_and_stay(spark):
    given_ = [(0, "a", 1, 1, "Staging", 1), (1, "a", 1, None, None, 1), (0, "a", 1, 1, "Archived", 100)]
    df = spark.createDataFrame(rows(*given_), SCHEMA)
    ledger = L.version_ledger(df)
    assert history(spark, given_) == [("a", 1, "Archived", 1, 0, None)]
    assert {r.stage for r in ledger.collect()} == {"Staging", "Archived"}
    early = L.version_history(df, recorded=int((T0 + timedelta(days=2) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000)
    assert {r.stage for r in early.collect()} == {"Staging"}


def test_ties_repeats_and_null_columns(spark):
    one = (0, "a", 1, 1, "Staging", 1)
    assert history(spark, [one, one, one]) == [("a", 1, "Staging", 1, 0, None)]
    assert history(spark, [one, (0, "a", 1, 1, "Archived", 1)]) == [("a", 1, "Staging", 1, 0, None)]  # the greater one
    assert history(spark, [(0, None, 1, 1, "Staging", 1), (0, "a", None, 1, "Staging", 1)]) == []
    assert history(spark, [(0, "a", 1, None, "no such stage", 1)]) == [("a", 1, None, None, 0, None)]


def test_empty(spark):
    assert L.version_history(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame(rows((0, "a", 1, 1, "Staging", 1)), SCHEMA)
    for c in ("valid_from", "valid_to", "recorded_at", "vf", "k0", "a0", "__run"):
        df = df.selectExpr("*", f"'x' as {c}")
    assert L.version_history(df).count() == 1


def test_overlapping_intervals_are_split(spark):
    u = spark.createDataFrame([("k", 0, None, 1, "a"), ("k", 10, 20, 2, "b"), ("k", 15, 30, 3, "c")], "key string, valid_from bigint, valid_to bigint, recorded_at bigint, v string")
    ledger = L.bitemporal_ledger(u, ["key"], ["v"])
    now = sorted((r.valid_from, r.valid_to, r.v) for r in L.coalesce_runs(L.as_believed(ledger), ["key"], ["v"]).collect())
    assert now == [(0, 10, "a"), (10, 15, "b"), (15, 30, "c"), (30, None, "a")]
    then = sorted((r.valid_from, r.valid_to, r.v) for r in L.coalesce_runs(L.as_believed(ledger, 2), ["key"], ["v"]).collect())
    assert then == [(0, 10, "a"), (10, 20, "b"), (20, None, "a")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 8), st.integers(0, 6), st.sampled_from([None, "x", "y"])), max_size=12), st.integers(0, 7))
def test_sweep_equals_brute_force(updates, now):
    rows_ = [(a, a + n, rec, (v,)) for a, n, rec, v in dict.fromkeys(updates)]
    got = {}
    for vf, vt, since, until, attrs in L._sweep(rows_, False):
        if since <= now and (until is None or until > now):
            for t in range(vf, vt):
                assert t not in got
                got[t] = attrs[0]
    want = {}
    for t in range(25):
        known = [(rec, v is not None, v or "") for a, b, rec, (v,) in rows_ if a <= t < b and rec <= now]
        if known:
            want[t] = max(known)[2] or None
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_history_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    given_ = []
    for day in range(8):
        for v in range(3):
            for _ in range(rnd.choice([0, 1, 1, 2])):
                given_.append((day, "m", v, rnd.choice([None, 1, 2]), rnd.choice([None, "Staging", "production"]), rnd.randint(0, 400)))
    given_ += rnd.choices(given_, k=5)
    days = sorted({g[0] for g in given_})
    want = []
    for v in range(3):
        state, runs, seen = {}, [], [None, None]
        for n, day in enumerate(days):
            own = [g for g in given_ if g[0] == day and g[2] == v]
            if not own:
                state[n] = None
                continue
            best = max(own, key=lambda g: (g[5], g[4] is not None, (g[4] or "").capitalize(), g[3] is not None, g[3] or 0))
            seen = [best[3] if best[3] is not None else seen[0], best[4].capitalize() if best[4] else seen[1]]
            state[n] = tuple(seen)
        for n in range(len(days)):
            if state.get(n) is None:
                continue
            if runs and runs[-1][1] == n and runs[-1][2] == state[n]:
                runs[-1][1] = n + 1
            else:
                runs.append([n, n + 1, state[n]])
        want += [("m", v, s[1], s[0], days[a], days[b] if b < len(days) else None) for a, b, s in runs]
    assert history(spark, given_) == sorted(want, key=repr)
