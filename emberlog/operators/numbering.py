"""Dense numbers over all rows, or over the rows of each key, without putting a whole table or a hot key into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.plans.session import cut


def number_rows(rows: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Dense numbers from 0 in the given order: sorted by ranges, numbered in each range, shifted by the ranges' running counts."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per range
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("__r", place).join(sizes.select("__p", before.alias("__b")), "__p").withColumn(name, F.col("__b") + F.col("__r") - 1).drop("__p", "__r", "__b")


def number_in_keys(rows: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Numbers from 0 of each key's rows in the given order.

    As ``row_number`` over the keys, but a key may spread over several ranges: rows are numbered in (key, range), and the
    key's counts in the ranges before are added. So a key with a third of all rows takes as many tasks as a third of the ranges.
    """
    ranged = cut(rows.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(*keys, "__p", before.alias("__b")).filter("__b > 0")
    place = F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(*order)) - 1
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    on = F.col("l.__p") == F.col("r.__p")
    for c in same:
        on = on & c
    joined = ranged.withColumn("__r", place).alias("l").join(shifts.alias("r"), on, "left")
    return joined.select(*[F.col(f"l.`{c}`") for c in rows.columns], (F.col("l.__r") + F.coalesce(F.col("r.__b"), F.lit(0))).alias(name))
