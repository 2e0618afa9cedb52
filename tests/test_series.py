from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog.errors import DimensionMismatch, IndexNotReady
from emberlog.operators import knn as K
from emberlog.operators import registry as R
from emberlog.operators import series as S
from emberlog.operators import sparse as P
from emberlog.operators import tensor as X
from emberlog.operators.ann import HashIndex, ListIndex
from emberlog.streaming import streams


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(0)
    rows = [("a" if i % 3 else "b", i, float(x)) for i, x in enumerate(rng.normal(10, 2, 200))]
    return spark.createDataFrame(rows, "key string, seq bigint, f double")


def test_rolling_is_pandas(series):
    got = S.rolling(series, 10).toPandas().sort_values(["key", "seq"])
    p = series.toPandas().sort_values(["key", "seq"])
    roll = p.groupby("key").f.rolling(10)
    assert np.allclose(got.roll_mean, roll.mean().dropna()) and np.allclose(got.roll_std, roll.std(ddof=0).dropna()) and np.allclose(got.roll_median, roll.median().dropna())


def test_backtest_and_performance(spark):
    prices = [10.0, 11.0, 12.0, 9.0, 9.0, 0.0]
    df = spark.createDataFrame([("k", n, p, s) for n, (p, s) in enumerate(zip(prices, [1, 0, -1, 1, 0, 0]))], "key string, seq bigint, f double, signal int")
    e = S.backtest(df, 100.0)
    assert [round(r.equity, 6) for r in e.orderBy("seq").collect()] == [100, 110, 120, 120, 120, 0]
    r = S.performance(e).collect()[0]
    assert round(r.total_return, 6) == -1 and r.max_drawdown == 1
    assert S.backtest(df.drop("signal"), 100.0, strategy=lambda p: np.ones(len(p))).count() == 6


def test_series_of_nothing_and_nulls(spark, series):
    empty = series.limit(0)
    for out in (S.rolling(empty, 3), S.differences(empty), S.describe(empty), S.drift(empty), S.downsample(empty, 2), S.zscore_anomalies(empty), S.drawdown(empty), S.bollinger(empty), S.crossover(empty)):
        assert out.count() == 0
    flat = spark.createDataFrame([("k", n, 1.0) for n in range(30)] + [("k", 30, None), ("z", 1, None)], "key string, seq bigint, f double")
    assert S.zscore_anomalies(flat).count() == 0 and S.stats(flat).filter("key = 'z'").collect()[0]["n"] == 0


def test_search_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"key": range(300), "vector": [r.tolist() for r in x]}), "key bigint, vector array<float>")
    q = df.filter("key % 50 = 0").select(F.col("key").alias("qid"), "vector")
    for metric in ("cosine", "euclidean", "dot"):
        got = {(r.qid, r["rank"]): r.key for r in K.search_batch(df, q, 5, metric).collect()}
        from emberlog.functions.distance import distance_matrix

        d = distance_matrix(metric, x[::50], x)
        for i in range(6):
            assert [got[i * 50, n + 1] for n in range(5)] == np.argsort(d[i], kind="stable")[:5].tolist()
        single = [r.key for r in K.search(df, x[0].tolist(), 5, metric).collect()]
        assert single == np.argsort(d[0], kind="stable")[:5].tolist()
    exact = K.search_batch(df, q, 10)
    index = ListIndex().fit(df)
    assert K.recall_at(index.search(index.place(df), q, 10, len(index.centres)), exact, 10).agg(F.avg("recall")).first()[0] == 1.0
    hashes = HashIndex.preset("high_recall")
    assert K.recall_at(hashes.search(hashes.buckets(df), df, q, 10), exact, 10).agg(F.avg("recall")).first()[0] >= 0.9
    blocks = {(r.qid, r["rank"]): r.key for r in K.search_blocks(df, q, 5, block=64).collect()}
    want = {(r.qid, r["rank"]): r.key for r in K.search_batch(df, q, 5).collect()}
    assert blocks == want
    assert K.plan_search(100, 5) == "exact" and K.plan_search(10**6, 5, index=index) == "index"


def test_list_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 32))
    x = (centres[rng.integers(0, 20, 2000)] + 0.3 * rng.normal(size=(2000, 32))).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"key": range(2000), "vector": [r.tolist() for r in x]}), "key bigint, vector array<float>")
    q = df.filter("key % 50 = 0").select(F.col("key").alias("qid"), "vector")
    index = ListIndex().fit(df)
    placed, exact = index.place(df).cache(), K.search_batch(df, q, 10).cache()
    assert K.recall_at(index.search(placed, q, 10, 20), exact, 10).agg(F.avg("recall")).first()[0] >= 0.95
    assert index.scanned(placed, q, 10, 20) <= 0.12
    hashes = HashIndex.sized(2000)
    buckets = hashes.buckets(df).cache()
    assert K.recall_at(hashes.search(buckets, df, q, 10), exact, 10).agg(F.avg("recall")).first()[0] >= 0.95
    assert hashes.scanned(buckets, 2000, q) <= 0.12
    more = q.join(spark.range(110).withColumnRenamed("id", "again")).select((F.col("qid") * 1000 + F.col("again")).alias("qid"), "vector")
    many = index.search(placed, more, 1)  # more queries than one block
    assert many.count() == 4400 and many.filter("qid div 1000 <> key").count() == 0
    assert K.search_batch(df, more, 1).filter("qid div 1000 <> key").count() == 0


def test_stored_indexes(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"key": range(400), "vector": [r.tolist() for r in x]}), "key bigint, vector array<float>")
    q = df.filter("key % 50 = 0").select(F.col("key").alias("qid"), "vector")
    lists, hashes = ListIndex().fit(df), HashIndex.sized(400)
    lists.save(df.filter("key < 300"), str(tmp_path / "l"))
    hashes.save(df.filter("key < 300"), str(tmp_path / "h"))
    lists, hashes = ListIndex.load(spark, str(tmp_path / "l"), 16), HashIndex.load(spark, str(tmp_path / "h"))
    for i in (lists, hashes):
        i.insert(df.filter("key >= 300"))
    rows = lambda f: sorted((r.qid, r["rank"], r.key) for r in f.collect())
    assert rows(lists.search(lists.stored(spark), q, 5)) == rows(lists.search(lists.place(df), q, 5))
    assert rows(hashes.search(*hashes.stored(spark), q, 5)) == rows(hashes.search(hashes.buckets(df), df, q, 5))
    one = lists.search(lists.stored(spark), q.filter("qid = 0"), 5, 2)
    assert "PartitionFilters: [" in one._jdf.queryExecution().toString() and len({p for p in lists.probes(x[:1], 5, 2)[0]}) == 2
    with pytest.raises(IndexNotReady):
        ListIndex.load(spark, str(tmp_path / "none"))
    with pytest.raises(DimensionMismatch):
        ListIndex.load(spark, str(tmp_path / "l"), 17)
    with pytest.raises(IndexNotReady):
        ListIndex().place(df)
    assert lists.search(lists.stored(spark), q.limit(0), 5).count() == 0


def test_dimensions_and_zero_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "key bigint, vector array<float>")
    assert [(r.key, r.score) for r in K.search(df, [1.0, 0.0], 2).collect()] == [(2, 0.0), (1, 1.0)]
    with pytest.raises(Exception, match="dimensions"):
        K.check_dims(df, 3).collect()


def test_sparse_by_hand(spark):
    p = spark.createDataFrame([(1, 100, 2.0), (1, 200, 1.0), (2, 100, 1.0), (2, 300, 3.0)], "doc_id bigint, term_id bigint, weight double")
    q = spark.createDataFrame([(100, 1.0), (300, 0.0), (200, -1.0)], "term_id bigint, weight double")
    assert [(r.doc_id, r.score) for r in P.search(p, q, 5).collect()] == [(1, 2.0), (2, 1.0)]
    s = P.index_stats(p).collect()[0]
    assert (s.num_documents, s.num_terms, s.num_postings, s.avg_doc_length) == (2, 3, 4, 2.0)
    assert P.index_stats(p.limit(0)).collect()[0]["num_postings"] == 0


def test_registry(spark):
    models = spark.createDataFrame([("m", 1, 10, "c", 5, "Production", {})], "name string, version int, created_at bigint, checksum string, size_bytes bigint, stage string, metadata map<string,string>")
    new = spark.createDataFrame([("m", bytearray(b"xx"), {}), ("n", bytearray(b"y"), {})], "name string, data binary, metadata map<string,string>")
    saved = R.save_models(models, new, F.lit(11).cast("bigint"))
    assert {(r.name, r.version, r.size_bytes) for r in saved.collect()} == {("m", 2, 2), ("n", 1, 1)}
    both = models.unionByName(saved)
    promoted = R.set_stage(both, spark.createDataFrame([("m", 2, "Production")], "name string, version int, stage string"))
    assert R.production_versions(promoted).collect()[0]["version"] == 2 and R.production_versions(promoted, True).collect()[0]["version"] == 1
    blobs = new.withColumn("version", F.lit(1))
    assert R.load_verified(saved.filter("name = 'n'"), blobs).count() == 1
    with pytest.raises(Exception, match="ChecksumMismatch"):
        R.load_verified(saved.withColumn("checksum", F.lit("bad")), blobs).collect()
    with pytest.raises(Exception, match="RunEnded"):
        R.check_running(spark.createDataFrame([(1,)], "run_id int"), spark.createDataFrame([(1, "Completed")], "run_id int, status string")).collect()
    with pytest.raises(Exception, match="duplicate document"):
        d = spark.createDataFrame([(1, "x")], "id int, content string")
        R.write_documents(d, d, "none").collect()


def test_tensors(spark):
    df = spark.createDataFrame([("t", [float(x) for x in range(100)], [10, 10]), ("e", [], [0])], "name string, data array<double>, shape array<bigint>")
    for dtype in X.DTYPES:
        chunks, meta = X.to_chunks(df, dtype, size=64, shape="shape")
        back = {r.name: (r.data, r["shape"]) for r in X.from_chunks(chunks, meta).collect()}
        assert back["t"] == ([float(x) for x in range(100)], [10, 10]) and back["e"][0] == []
        with pytest.raises(Exception, match="incomplete"):
            X.from_chunks(chunks.filter("chunk_id <> 1"), meta).collect()
    assert X.chunk_size(1) == 2**20 and X.chunk_size(50 * 2**20) == 4 * 2**20 and X.chunk_size(2**30) == 16 * 2**20
    docs = spark.createDataFrame([("1", "abc"), ("2", None)], "id string, content string")
    assert [r.vector for r in X.embed(docs, lambda ts: [[float(len(t))] for t in ts]).collect()] == [[3.0]]


def test_stream_state_goes_on_across_triggers(spark, tmp_path):
    for n in range(3):
        spark.range(n * 10, n * 10 + 10, numPartitions=1).selectExpr("id % 2 as user", "id as seq", "cast(id as double) as value").coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    schema = "user bigint, seq bigint, value double"
    src = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    got = {(r.user, r.seq): r.step for r in streams.run_to_end(streams.step_counter(src(), "user", "seq")).collect()}
    assert len(got) == 30 and sorted(v for (u, _), v in got.items() if u == 0) == list(range(15))
    up = streams.upsert_latest(src(), "user", "seq", ["value"]).collect()
    assert sorted((r.user, r.seq) for r in up) == [(0, 28), (1, 29)]


def test_blobs():
    x = np.arange(6, dtype=np.float32).reshape(2, 3)
    for dtype in X.DTYPES:
        assert (X.unpack_blob(X.pack_blob(x, dtype)) == x).all()


def test_chunked_windows_equal_whole_ones(series):
    for make in (lambda c: S.rolling(series, 7, chunk=c), lambda c: S.differences(series, chunk=c), lambda c: S.lags(series, (1, 4), chunk=c), lambda c: S.bollinger(series, 5, chunk=c), lambda c: S.crossover(series, 3, 6, chunk=c), lambda c: S.drawdown(series, chunk=c)):
        whole, cut = (sorted(map(repr, make(c).collect())) for c in (None, 11))
        assert whole == cut
    with pytest.raises(ValueError):
        S.rolling(series, 20, chunk=10)


def test_hot_keys_are_cut_and_give_the_same(spark, series, monkeypatch):
    def rows(df):
        return sorted(map(str, df.collect()))

    want = [S.rolling(series, 5), S.differences(series), S.lags(series, [1, 3]), S.bollinger(series, 5), S.crossover(series, 2, 5), S.drawdown(series)]
    want = [(rows(w), w.columns) for w in want]
    monkeypatch.setattr(S, "HOT_ROWS", 60)
    assert S.hot_chunk(series, 4) == 30 and S.hot_chunk(series.limit(0), 4) is None
    got = [S.rolling(series, 5), S.differences(series), S.lags(series, [1, 3]), S.bollinger(series, 5), S.crossover(series, 2, 5), S.drawdown(series)]
    for (w, columns), g in zip(want, got):
        assert rows(g.select(*columns)) == w
    points = series.withColumn("step", F.when(F.col("seq") % 9 == 4, F.col("seq") % 50)).withColumn("key", F.when(F.col("key") == "a", "a"))
    assert rows(S.auto_step(points, ["key"], "seq", rows=7)) == rows(S.auto_step(points, ["key"], "seq"))
    assert S.auto_step(points, ["key"], "seq").count() == 200
