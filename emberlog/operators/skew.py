"""Joins in which a key may hold a large share of all rows, or few rows of many match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 4096


def join_totals(facts: DataFrame, totals: DataFrame, key: str, rows: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``facts`` with the columns of ``totals`` (one row a key; ``rows``: how many facts the key has), as an inner join on ``key``.

    Keys with at least one of ``hot_keys`` parts of all facts are at most ``hot_keys`` in number, so their totals are broadcast and their
    facts stay where they are; the facts of the others, none with more than that share, are joined by a shuffle. Null keys match nothing.
    """
    others = [c for c in totals.columns if c != key]
    whole = totals.agg(F.sum(rows)).scalar()
    sized = totals.filter(F.col(key).isNotNull()).withColumn("__hot", F.col(rows) * hot_keys >= whole)
    hot = sized.filter("__hot").select(key, F.struct(*others).alias("__totals"))
    marked = facts.join(F.broadcast(hot), key, "left")
    found = marked.filter(F.col("__totals").isNotNull()).select(*facts.columns, *[F.col(f"__totals.{c}").alias(c) for c in others])
    rest = marked.filter(F.col("__totals").isNull()).select(*facts.columns)
    return found.unionByName(rest.join(sized.filter("not __hot").select(key, *others), key).select(*facts.columns, *others))


class Bitmap:
    """A set of keys as at most ``2 ** bits`` hashed bits (8 MB for 26), which tells quickly which rows can't match: a bounded broadcast however many keys there are.

    ``marked`` adds a flag that is true for every row whose key is in the set, and for few others: what is shuffled after it is about what matches.
    """

    def __init__(self, keys: DataFrame, key: str, bits: int = 26):
        self.bits = bits
        at = self._place(F.col(key))
        number, position = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
        self.blocks = keys.filter(F.col(key).isNotNull()).groupBy(number.alias("__block")).agg(F.bitmap_construct_agg(position).alias("__bits"))

    def _place(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(41), key), F.lit(1 << self.bits)) + 1

    def marked(self, rows: DataFrame, key: str, flag: str) -> DataFrame:
        at = self._place(F.col(key))
        placed = rows.withColumn("__block", F.bitmap_bucket_number(at)).withColumn("__at", F.bitmap_bit_position(at))
        byte = F.conv(F.hex(F.substring("__bits", (F.col("__at").cast("int") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.when(F.col("__bits").isNull() | F.col(key).isNull(), False).otherwise(F.expr("shiftright({b}, cast(__at % 8 as int)) & 1 = 1".replace("{b}", "__byte")))
        return placed.join(F.broadcast(self.blocks), "__block", "left").withColumn("__byte", byte).withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__block", "__at", "__bits", "__byte")

    def kept(self, rows: DataFrame, key: str) -> DataFrame:
        return self.marked(rows, key, "__in").filter("__in").drop("__in")
