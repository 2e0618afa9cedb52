from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators.skew import Bitmap, join_totals


def test_hot_and_other_keys_are_joined_alike(spark):
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("k"), F.col("id").alias("x"))
    totals = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))
    want = sorted(map(tuple, facts.join(totals, "k").select("k", "x", "n", "s").collect()))
    for hot_keys in (1, 4, 4096):
        assert sorted(map(tuple, join_totals(facts, totals, "k", "n", hot_keys).select("k", "x", "n", "s").collect())) == want


def test_nulls_and_empty(spark):
    facts = spark.createDataFrame([(None, 1), (1, 2)], "k int, x int")
    totals = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert [tuple(r) for r in join_totals(facts, totals, "k", "n").collect()] == [(1, 2, 1)]
    assert join_totals(facts.limit(0), totals.limit(0), "k", "n").count() == 0


def test_bitmap_never_denies_a_key(spark):
    rows = spark.range(-500, 5000).withColumn("t", F.col("id").cast("string"))
    for key, bits in (("id", 26), ("t", 26), ("id", 10)):
        bitmap = Bitmap(rows.filter("id % 7 = 0").select(key), key, bits)
        kept = {r.id for r in bitmap.kept(rows, key).collect()}
        want = {i for i in range(-500, 5000) if i % 7 == 0}
        assert want <= kept and (len(kept) < len(want) + 10 or bits == 10)
        assert bitmap.marked(rows, key, "maybe").columns == ["id", "t", "maybe"]
    assert Bitmap(rows.limit(0), "id").kept(rows, "id").count() == 0
    assert Bitmap(rows, "id").kept(spark.createDataFrame([(None,)], "id bigint"), "id").count() == 0
