from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import anomaly as A
from emberlog.streaming import streams


@pytest.fixture(scope="module")
def waves(spark):
    rng = np.random.default_rng(0)
    rows = [(k, i, float(np.sin(i / 3) * 5 + rng.normal() * 0.2)) for k in ("a", "b") for i in range(400)]
    rows[150] = ("a", 150, 40.0)
    return spark.createDataFrame(rows, "key string, seq bigint, f double")


def by_hand(f, model):
    z = (np.asarray(f) - model.mean) / (model.std + 1e-8)
    c = np.array(model.components)
    w = np.lib.stride_tricks.sliding_window_view(z, model.window)
    return ((w - w @ c.T @ c) ** 2).mean(axis=1)


def test_scores_are_reconstruction_errors(spark, waves):
    model = A.fit(waves, window=8, components=3)
    assert np.allclose(np.array(model.components) @ np.array(model.components).T, np.eye(3))
    got = A.scores(waves, model).toPandas().sort_values(["key", "seq"])
    for k in ("a", "b"):
        f = [r.f for r in waves.filter(F.col("key") == k).orderBy("seq").collect()]
        mine = got[got["key"] == k]
        assert mine["seq"].tolist() == list(range(7, 400)) and np.allclose(mine["score"], by_hand(f, model))
    flagged = got[got["anomaly"]]
    assert 0 < len(flagged) <= 0.02 * len(got) and set(flagged[flagged["score"] > 1]["key"]) == {"a"}
    assert flagged.sort_values("score")["seq"].iloc[-1] in range(150, 158)


def test_stream_gives_the_same_over_several_runs(spark, waves, tmp_path):
    model = A.fit(waves, window=8, components=3)
    waves.limit(0).write.parquet(str(tmp_path / "in"))
    stream = streams.anomalies(spark.readStream.schema(waves.schema).parquet(str(tmp_path / "in")), model, "key", "seq", "f")
    for n, part in enumerate(("seq < 5", "seq >= 5 and seq < 250", "seq >= 250")):
        waves.filter(part).write.mode("append").parquet(str(tmp_path / "in"))
        rows = streams.run_to_end(stream, folder=str(tmp_path / "run"))
    got, want = rows.filter("ready").toPandas().sort_values(["key", "seq"]), A.scores(waves, model).toPandas().sort_values(["key", "seq"])
    assert np.allclose(got["score"], want["score"]) and got["anomaly"].tolist() == want["anomaly"].tolist()
    assert rows.count() == 800 and rows.filter("not ready and (anomaly or score <> 0)").count() == 0


def test_nothing_nulls_and_one(spark, waves):
    empty = waves.limit(0)
    model = A.fit(empty)
    assert A.scores(empty, model).count() == 0 and A.fit(waves.filter("seq < 3")).components
    gaps = waves.withColumn("f", F.when(F.col("seq") % 2 == 0, F.col("f")))
    assert A.scores(gaps, A.level_model(gaps, 4)).count() == 2 * 197
    assert A.scores(waves, A.level_model(waves, 1)).agg(F.max("score")).first()[0] < 1e-12


def test_upserts_go_on_and_are_folded(spark, waves, tmp_path):
    waves.limit(0).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(waves.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for a in range(0, 400, 100):
        waves.filter((F.col("seq") >= a) & (F.col("seq") < a + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = streams.upsert_latest(stream, "key", "seq", ["f"], folder=str(tmp_path / "run"), fold=2)
        assert {(r.key, r.seq) for r in rows.collect()} == {("a", a + 99), ("b", a + 99)}
    assert len(list((tmp_path / "run").glob("base-*"))) == 2
