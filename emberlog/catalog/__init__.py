"""Queries of the core, by name, with the SQL that DuckDB runs for the same result.

Doubles are rounded to six decimals on both sides, since sums in another order differ in their last digits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.catalog import dense, history, io, kv, lexical, platform, relational, series, storage, streams, tensors
from emberlog.catalog.doubles import DOUBLES

MODULES = (history, kv, series, dense, lexical, platform, tensors, relational, streams, io, storage)


def rounded(query: Callable) -> Callable:
    @wraps(query)
    def run(spark, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        floats = [c for c, kind in df.dtypes if kind in ("double", "float")]
        return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in floats}) if floats else df

    return run


def rounded_sql(sql: str, columns: list[str]) -> str:
    if not columns:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in columns)}) FROM ({sql.strip()})"


def queries() -> dict:
    return {k: rounded(f) for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: rounded_sql(s, DOUBLES.get(k, [])) for m in MODULES for k, s in m.ORACLE.items()}
