"""Epoch conversions that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone (read as UTC); null stays null."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), c.cast("timestamp_ntz"))


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970, rounded down."""
    return F.floor(epoch_micros(ts) / F.lit(1_000_000)).cast("bigint")


def to_epoch_seconds(c: Column) -> Column:
    """An epoch number of unknown unit in seconds: seconds, milli-, micro- or nanoseconds are told apart by size.

    Below 1e11 it is seconds (until the year 5138), below 1e14 milliseconds, below 1e17 microseconds, else nanoseconds.
    """
    a = F.abs(c)
    return (
        F.when(a < F.lit(10**11), c)
        .when(a < F.lit(10**14), F.floor(c / F.lit(10**3)))
        .when(a < F.lit(10**17), F.floor(c / F.lit(10**6)))
        .otherwise(F.floor(c / F.lit(10**9)))
        .cast("bigint")
    )
