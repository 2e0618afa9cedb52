from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from emberlog import errors
from emberlog.operators import stores as S
from emberlog.operators.log import LogStore
from emberlog.sources import loaders


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "s"))


def test_vectors(spark, store):
    v = S.VectorStore(store, 2)
    assert v.insert_batch(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "key string, vector array<float>")) == 2
    v.insert("a", [0.0, 2.0])
    assert v.get("a") == [0.0, 2.0] and v.get("none") is None and len(v) == 2
    assert [r.key for r in v.search([0.0, 1.0], 1).collect()] == ["a"]
    first = S.VectorStore(store, 2, keep="first")
    assert {r.key: r.vector for r in first.rows().collect()}["a"] == [1.0, 0.0]
    v.delete("a")
    assert [r.key for r in v.search([0.0, 1.0], 5).collect()] == ["b"]
    for bad in (lambda: v.insert("x", [1.0]), lambda: v.search([1.0], 1)):
        with pytest.raises(errors.DimensionMismatch):
            bad()


def test_tiers(spark, store):
    hot, cold = S.VectorStore(store, 2, prefix="hot/"), S.VectorStore(store, 2, prefix="cold/")
    t = S.TieredStore(hot, cold)
    t.insert_batch(spark.createDataFrame([("a", [1.0, 0.0])], "key string, vector array<float>"))
    cold.insert("b", [0.0, 1.0])
    assert [(r.key, r.source) for r in t.search([1.0, 0.1], 2).collect()] == [("a", "hot"), ("b", "cold")]
    assert t.promote() == 1 and t.promote() == 0 and len(hot) == 1 and t.keys().count() == 2


def test_sparse(spark, tmp_path):
    s = S.SparseStore(spark, str(tmp_path / "sp"))
    s.index({1: 2.0, 2: -1.0}, "a")
    s.index({1: 5.0, 3: 1.0}, "a")
    s.index({1: 1.0})
    assert s.get("a") == {1: 5.0, 3: 1.0} and s.get("z") == {}
    assert [(r.key, r.score) for r in s.search({1: 1.0}, 5).collect()] == [("a", 5.0), ("_doc_3", 1.0)]
    assert s.stats().collect()[0]["num_documents"] == 2


def test_sparse_maintenance(spark, tmp_path):
    path = str(tmp_path / "sp")
    s = S.SparseStore(spark, path)
    a, b, c, d = s.index({1: 1.0}, "a"), s.index({1: 2.0}, "b"), s.index({1: 3.0}, "a"), s.index({1: 4.0})
    assert len(s) == 3 and {r.key for r in s.keys().collect()} == {"a", "b"}
    assert s.delete("b") and not s.delete("b") and not s.delete("none") and s.get("b") == {}
    assert s.delete_by_id(c) and not s.delete_by_id(a) and len(s) == 1  # what was stale stays so
    assert [(r.doc_id, r.score) for r in s.search({1: 1.0}, 5).collect()] == [(d, 4.0)]
    assert s.index({1: 5.0}, "a") == 5 and S.SparseStore(spark, path).get("a") == {1: 5.0}
    s.clear()
    assert len(s) == 0 and s.search({1: 1.0}, 5).count() == 0 and s.index({}, "e") == 6 and len(s) == 1
    damaged = tmp_path / "sp" / "postings" / "part-bad.parquet"
    damaged.write_bytes(b"no parquet")
    with pytest.raises(Exception):
        S.SparseStore(spark, path).rows().count()  # a damaged store is no new store


def test_stored_vector_index(spark, store, tmp_path):
    v = S.VectorStore(store, 2)
    v.insert_batch(spark.createDataFrame([(f"k{i}", [1.0, i / 50]) for i in range(100)], "key string, vector array<float>"))
    for n, index in enumerate((None, S.HashIndex.preset("high_recall"))):
        built = v.build_index(str(tmp_path / f"i{n}"), index)
        probes = {"nprobe": 8} if index is None else {}
        assert [r.key for r in v.search([1.0, 0.5], 3, built, **probes).collect()][0] == "k25"
    v.delete("k25")
    assert "k25" not in [r.key for r in v.search([1.0, 0.5], 3, built).collect()]


def test_models(store):
    m = S.Models(store)
    assert m.save("n", b"one") == 1 and m.save("n", b"two", {"acc": "1"}) == 2
    assert m.load("n") == b"two" and m.load("n", 1) == b"one"
    m.set_stage("n", 1, "Production")
    assert m.production("n") == 1
    m.delete("n", 2)
    assert m.load("n") == b"one"
    with pytest.raises(errors.KeyNotFound):
        m.load("x")


def test_experiments(store):
    e = S.Experiments(store, "x")
    a, b = e.start_run(1, ["base"]), e.start_run(2, ["base", "new"])
    e.log_param(a, "lr", 0.1)
    e.log_metrics(a, "loss/train", [3.0, 2.0])
    e.log_metrics(a, "loss/train", [1.0])
    e.log_artifact(a, "w", b"12")
    assert [(r.step, r.value, r.name) for r in e.metrics().orderBy("step").collect()] == [(0, 3.0, "loss/train"), (1, 2.0, "loss/train"), (2, 1.0, "loss/train")]
    assert e.artifacts().collect()[0]["size_bytes"] == 2
    assert [r.run_id for r in e.query(tags=["base"]).collect()] == [b, a] and [r.run_id for r in e.query(params={"lr": "0.1"}).collect()] == [a]
    e.end_run(a, 9)
    with pytest.raises(errors.RunEnded):
        e.log_param(a, "x", 1)
    assert [r.run_id for r in e.query(status="completed").collect()] == [a]
    e.mark(b, "deleted")
    assert e.query().count() == 1 and e.query(lifecycle_stage="all").count() == 2
    assert e.compare([a, b]).filter(F.col("run_id") == a).filter("kind = 'latest'").collect()[0]["value"] == "1.0"


def test_transitions(spark, store):
    t = S.Transitions(store)
    rows = spark.createDataFrame([("s", "m", 1, [1.0], "go", 1.0, [2.0]), ("s", "m", 2, [1.0], "go", 1.0, [2.0]), (None, "m", 3, None, "go", None, [])], t.RECORD)
    assert t.log(rows) == 2 and t.log(rows) == 0
    assert t.sessions().count() == 1 and t.stats().filter("session_id = 's'").collect()[0]["total_reward"] == 1.0


def test_chats_and_documents(spark, store):
    c = S.Chats(store)
    c.add("a", "user", "hi")
    c.clear("a")
    c.add("a", "user", "again")
    assert [r.content for r in c.messages("a").orderBy("seq").collect()] == ["again"] and c.sessions().count() == 1
    d = S.Documents(store, S.VectorStore(store, 2))
    docs = spark.createDataFrame([("1", "x", {"c": "u"}, [1.0, 0.0]), ("2", "y", {"c": "w"}, [0.0, 1.0])], "id string, content string, meta map<string,string>, vector array<float>")
    assert d.write(docs) == 2 and d.write(docs, "skip") == 0 and d.write(docs, "overwrite") == 2
    with pytest.raises(ValueError):
        d.write(docs)
    assert [r.id for r in d.filter({"c": "u"}).collect()] == ["1"] and d.filter({"none": "u"}).count() == 0
    assert [r.id for r in d.similar([0.1, 1.0], 1).collect()] == ["2"] and [r.id for r in d.similar([0.1, 1.0], 1, {"c": "u"}).collect()] == ["1"]
    d.delete("1")
    assert d.rows().count() == 1
    a = S.Async(c)
    a.submit("add", "b", "user", "x").result()
    a.close()
    assert c.sessions().count() == 2


def test_functions_and_bytes(spark):
    assert "cosine_distance" in S.register_functions(spark)
    assert spark.sql("SELECT cosine_distance(array(1.0D, 0.0D), array(1.0D, 0.0D)) AS d").first()[0] == 0.0
    df = spark.createDataFrame([({7: 1.5, 2: 0.5},), ({},)], "m map<bigint,float>")
    assert [S.read_sparse_bytes(bytes(r[0])) for r in df.select(S.sparse_bytes(F.col("m"))).collect()] == [{2: 0.5, 7: 1.5}, {}]


def test_loaders(spark):
    rows = spark.range(25).select(F.col("id").alias("key"), (F.col("id") * 2).alias("x"))
    got = list(loaders.iterate(rows, 10))
    assert [len(b["x"]) for b in got] == [10, 10, 5] and got[0]["key"].tolist() == list(range(10))
    assert [len(b["x"]) for b in loaders.iterate(rows, 10, shuffle_seed=1, drop_last=True)] == [10, 10]
    parts = [{r.key for r in loaders.replica(rows, 3, i).collect()} for i in range(3)]
    assert sorted(map(len, parts)) == [8, 8, 9] and set().union(*parts) == set(range(25))
