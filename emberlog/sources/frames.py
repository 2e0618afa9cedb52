"""Long series to wide tables and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.numbering import number_in_keys, number_rows


def to_wide(series: DataFrame, names: Sequence[str], key: str = "key", order: str = "seq", value: str = "f", ts: str | None = None) -> DataFrame:
    """One row per position, one column per key; shorter series end in nulls. ``ts`` adds the earliest time of the position."""
    rows = number_in_keys(series.filter(F.col(key).isin(list(names))), [key], [order])  # a long series is numbered by ranges
    extra = [F.min(ts).alias(ts)] if ts else []
    return rows.groupBy("pos").pivot(key, list(names)).agg(F.first(value).alias("v"), *extra) if ts else rows.groupBy("pos").pivot(key, list(names)).agg(F.first(value))


def from_wide(wide: DataFrame, prefix: str = "", order: str | None = None) -> DataFrame:
    """(key, pos, tag, f, i, s): every cell that isn't null as a value of the key prefix + column, in row order.

    Booleans and whole numbers become ints, fractions floats, the rest text. ``order`` names the column that orders the rows
    (default: as they come); it is not stored itself.
    """
    cols = [f for f in wide.schema.fields if f.name != order]
    numbered = number_rows(wide, [order], "__pos") if order else wide.withColumn("__pos", F.monotonically_increasing_id())
    whole, fraction = ("boolean", "tinyint", "smallint", "int", "bigint"), ("float", "double")

    def cell(f):
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        tag = "int" if kind in whole else "float" if kind in fraction or kind.startswith("decimal") else "text"
        none = F.lit(None)
        payload = [c.cast("double") if tag == "float" else none.cast("double"), c.cast("bigint") if tag == "int" else none.cast("bigint"), c.cast("string") if tag == "text" else none.cast("string")]
        return F.when(c.isNotNull(), F.struct(F.lit(prefix + f.name).alias("key"), F.lit(tag).alias("tag"), payload[0].alias("f"), payload[1].alias("i"), payload[2].alias("s")))

    cells = numbered.select(F.col("__pos").alias("pos"), F.explode(F.array_compact(F.array(*[cell(f) for f in cols]))).alias("c"))
    return cells.select("c.key", "pos", "c.tag", "c.f", "c.i", "c.s")
