"""Properties of the log: last write wins, histories, deletes, compaction, types, patterns, formats."""

from __future__ import annotations

import fnmatch
import json
import re
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from emberlog import errors
from emberlog.functions import atoms, patterns
from emberlog.operators import log as L
from emberlog.sources import exchange, rawlog


@pytest.fixture
def store(spark, tmp_path):
    return L.LogStore(spark, str(tmp_path / "store"))


def test_put_get_delete_resurrect_compact(store):
    store.put("a", f=1.0)
    store.put("a", s="text")
    store.put("b", i=7)
    assert store.get("a")["s"] == "text" and store.get("a")["tag"] == "text"
    store.delete("a")
    store.delete("never")
    assert store.get("a") is None
    assert {r.key for r in L.keys(store.log()).collect()} == {"b"}
    assert L.history(store.log()).filter("key = 'a'").count() == 2  # values before a delete stay in the history
    store.put("a")
    assert store.get("a")["tag"] == "null"  # a stored null exists
    assert L.resurrections(store.log()).collect()[0]["n"] == 1
    before = {(r.key, r.tag, r.i) for r in L.latest(store.log()).collect()}
    store.compact()
    assert {(r.key, r.tag, r.i) for r in L.latest(store.log()).collect()} == before
    assert store.log().count() == 2


def test_batch_keeps_order(store):
    assert store.put_floats("k", []) == 0
    assert store.put_floats("k", [float(x) for x in range(50)]) == 50
    assert [r.f for r in L.float_history(store.log()).orderBy("pos").collect()] == [float(x) for x in range(50)]


def test_keys_are_checked(store, spark, tmp_path):
    for key, error in (("", errors.EmptyKey), ("x" * 70_000, errors.KeyTooLong)):
        with pytest.raises(error):
            store.put(key, i=1)
    with pytest.raises(errors.StoreNotFound):
        L.LogStore(spark, str(tmp_path / "none"), create=False)
    assert errors.KeyNotFound("x").code == -5 and errors.TypeMismatch("x").code == -6


def test_unicode_keys_are_bytes(store):
    store.put("caf\u00e9", i=1)
    store.put("cafe\u0301", i=2)
    assert L.keys(store.log()).count() == 2


def test_strict_types(store):
    store.put("a", f=1.0)
    assert atoms.strict(L.latest(store.log()), "float").collect()[0]["value"] == 1.0
    with pytest.raises(PySparkException, match="type mismatch"):
        atoms.strict(L.latest(store.log()), "int").collect()


def test_hot_key_is_numbered_in_pieces(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"), F.col("id").alias("seq"), F.lit("P").alias("op"))
    got = L.history(df)
    w = got.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("m"), F.countDistinct("pos").alias("d"))
    assert w.filter("m <> n - 1 or d <> n").count() == 0
    assert L.history(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab/*?[]!x", max_size=8), st.text(alphabet="ab/x[]", max_size=8))
def test_glob_is_fnmatch(pattern, key):
    if re.search(r"\[[^\]]*$|\[\]|\[!\]|\[[^\]]*\[", pattern):
        return
    assert bool(re.match(patterns.glob_regex(pattern).replace("\\z", "\\Z"), key)) == fnmatch.fnmatchcase(key, pattern)


def test_number_casts(spark):
    rows = [("float", 3.9, None), ("float", -3.9, None), ("float", 1e30, None), ("float", float("nan"), None), ("int", None, 2**31 + 5), ("int", None, -(2**31) - 1), ("text", None, None)]
    df = spark.createDataFrame(rows, "tag string, f double, i bigint").withColumns({"s": F.lit("x"), "b": F.lit(None).cast("binary"), "v": F.lit(None).cast("array<float>")})
    assert [r[0] for r in df.select(atoms.as_double("int32")).collect()] == [3, -3, 2**31 - 1, 0, -(2**31) + 5, 2**31 - 1, None]


value = st.one_of(st.just(("null", None)), st.floats(allow_nan=False).map(lambda x: ("float", x)), st.integers(-(2**63), 2**63 - 1).map(lambda x: ("int", x)), st.text(max_size=30).map(lambda x: ("text", x)), st.binary(max_size=30).map(lambda x: ("bytes", x)), st.lists(st.floats(width=32, allow_nan=False), max_size=5).map(lambda x: ("vector", x)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(min_size=1, max_size=10), value), max_size=8))
def test_raw_entries_roundtrip(entries):
    data = b"".join(rawlog.encode_entry(k, *v) for k, v in entries)
    got, skipped = rawlog.scan(data)
    assert skipped == 0 and [(e[2], (e[4], e[5])) for e in got] == entries


def test_raw_log_with_damage(spark, tmp_path):
    good = [rawlog.encode_entry(f"k{n}", "float", float(n), 1_700_000_000_000_000 + n) for n in range(5)]
    data = good[0] + good[1] + b"\xff" * 20 + good[2] + good[3] + good[4][:10]
    (tmp_path / "x.log").write_bytes(data)
    df = rawlog.read_raw_logs(spark, str(tmp_path))
    assert [r.f for r in df.orderBy("seq").collect()] == [0.0, 1.0, 2.0, 3.0]
    assert rawlog.recovery(spark, str(tmp_path)).collect()[0]["recovered"] == 4


def test_lz4_block():
    # ten literals, then a match of ten at distance ten, then the last literals
    plain = b"0123456789" * 2 + b"end"
    block = len(plain).to_bytes(4, "little") + bytes([0xA6]) + b"0123456789" + (10).to_bytes(2, "little") + bytes([0x30]) + b"end"
    assert rawlog.lz4_block(block) == plain


def test_raw_differences(spark):
    rows = [("p", 0, 1, "k", "P", "float", False, 5.0), ("p", 9, 1, "k", "P", "float", True, 2.0), ("p", 18, 1, "k", "P", "float", False, 1.0), ("p", 27, 1, "k", "P", "float", True, 1.0)]
    df = spark.createDataFrame(rows, "path string, seq bigint, ts_micros bigint, key string, op string, tag string, is_delta boolean, f double")
    assert [r.f for r in rawlog.undo_differences(df).orderBy("seq").collect()] == [5.0, 7.0, 1.0, 2.0]


def test_exchange_roundtrip(store, spark, tmp_path):
    store.put("a/f", f=1.5)
    store.put("a/i", i=3)
    store.put("a/s", s='say "x", y\n')
    store.put("a/b", b=bytearray(b"\x00\xff"))
    store.put("a/v", v=[1.0, 2.0])
    log = store.log()
    want = {(r.key, r.tag) for r in L.latest(log).collect()}
    for name, write, read in (("p", exchange.export_parquet, exchange.import_parquet), ):
        assert write(log, str(tmp_path / name)) == 5
        back = read(spark, str(tmp_path / name))
        assert {(r.key, r.tag) for r in back.collect()} == want
        assert back.filter("key = 'a/s'").collect()[0]["s"] == 'say "x", y\n'
    assert exchange.export_json(log, str(tmp_path / "x.json"), "a/*") == 5
    assert json.loads((tmp_path / "x.json").read_text())["a/v"] == [1.0, 2.0]
    assert {r.tag for r in exchange.import_json(spark, str(tmp_path / "x.json")).collect()} == {"float", "int", "text"}
    assert exchange.export_arrow(log, str(tmp_path / "x.feather")) == 5
    assert exchange.export_binary(log, str(tmp_path / "mp"), exchange.msgpack) == 5
    assert exchange.export_binary(log, str(tmp_path / "cb"), exchange.cbor) == 5


def test_binary_encodings():
    assert exchange.msgpack({"a": 1}) == b"\xdf\x00\x00\x00\x01\xa1a\x01"
    assert exchange.cbor({"a": -1}) == b"\xa1aa\x20"
    assert exchange.msgpack(1.5) == b"\xcb" + struct.pack(">d", 1.5) and exchange.cbor(None) == b"\xf6"


def test_open_and_close(spark, tmp_path):
    a = L.open_store(spark, str(tmp_path / "s"))
    assert L.open_store(spark, str(tmp_path / "s")) is a
    L.close_store(str(tmp_path / "s"))
    with pytest.raises(errors.StoreNotFound):
        L.close_store(str(tmp_path / "s"))


def test_a_broken_compaction_is_put_right(spark, tmp_path):
    import os
    import shutil

    def state():
        return {(r.key, r.i) for r in L.latest(L.LogStore(spark, path).log()).collect()}

    path = str(tmp_path / "s")
    store = L.LogStore(spark, path)
    for i in range(3):
        store.put("a", i=i)
    want = {("a", 2)}
    shutil.copytree(path, path + "-compacting")  # stopped while writing
    os.remove(path + "-compacting/_SUCCESS") if os.path.exists(path + "-compacting/_SUCCESS") else None
    assert state() == want and not os.path.exists(path + "-compacting")
    os.rename(path, path + "-before")  # stopped before the new log was whole
    assert state() == want and not os.path.exists(path + "-before")
    shutil.copytree(path, path + "-compacting")
    open(path + "-compacting/_SUCCESS", "w").close()
    os.rename(path, path + "-before")  # stopped between the two renames
    assert state() == want and not os.path.exists(path + "-before") and not os.path.exists(path + "-compacting")
    shutil.copytree(path, path + "-before")  # stopped before the old log was deleted
    assert state() == want and not os.path.exists(path + "-before")
    L.LogStore(spark, path).compact()
    assert state() == want and L.LogStore(spark, path).log().count() == 1


def test_without_sync_writes_are_kept_and_seen(spark, tmp_path):
    path = str(tmp_path / "s")
    store = L.open_store(spark, path, config=L.StoreConfig(sync=False, delta=True))
    store.put("a", f=1.5)
    store.put("b", s="x")
    store.put("a", v=[1.0, 2.0])
    store.delete("b")
    assert store.get("a")["v"] == [1.0, 2.0] and store.get("b") is None
    assert L.LogStore(spark, path).log().count() == 0
    assert store.put_floats("c", [1.0, 2.0]) == 2  # a batch writes what was kept before it
    assert [r.key for r in store.log().orderBy("seq").collect()] == ["a", "b", "a", "b", "c", "c"]
    store.put("d")
    L.close_store(path)
    assert L.LogStore(spark, path).get("d")["tag"] == "null"
    with pytest.raises(errors.EmptyKey):
        store.put("", i=1)
    with pytest.raises(ValueError):
        store.put("k", z=1)


def test_delete_matching(store):
    for k in ("t/1", "t/2", "u/1"):
        store.put(k, i=1)
    assert store.delete_matching("t/*") == 2 and store.delete_matching("t/*") == 0
    assert {r.key for r in L.keys(store.log()).collect()} == {"u/1"}


def test_appends_of_many_ranges_are_dense(spark, store):
    store.put("x", i=0)
    rows = spark.range(0, 5000, 1, 16).select(F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).alias("key"), *L.atom(i=F.col("id")))
    assert store.append(rows, [F.col("i")]) == 5000
    assert store.log().filter("key <> 'x' and seq <> i + 2").count() == 0 and store.append(rows.limit(0)) == 0


def test_deltas_by_blocks(spark):
    df = spark.createDataFrame([("a", i, float(i * i % 17)) for i in range(100)] + [("b", i, None if i == 3 else 1.0) for i in range(9)], "key string, seq int, f double")
    enc = L.delta_encode(df, block=10)
    assert enc.filter("key = 'a' and not is_delta").count() == 10
    assert L.delta_decode(enc, block=10).filter("abs(decoded - f) > 1e-9").count() == 0
