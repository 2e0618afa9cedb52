"""Windows and time series over rows (key, order, value): Spark windows and aggregations, one exchange by key each."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.numbering import number_in_keys


def _by(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def rolling(df: DataFrame, n: int, key: str = "key", order: str = "seq", value: str = "f", full: bool = True, chunk: int | None = None) -> DataFrame:
    """Mean, population std, min, max, range and median of the last n values; full windows only, or nulls before that.

    ``chunk``: rows per task of a key (see ``chunked``); where it isn't given, keys are counted, and those of more than HOT_ROWS rows are cut.
    """
    chunk = chunk or hot_chunk(df, n - 1, key)
    df, by = _spread(df, n - 1, chunk, key, order)
    w = by.rowsBetween(-(n - 1), 0)
    v = F.col(value)
    stats = {"mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v), "range": F.max(v) - F.min(v), "median": F.percentile(v, F.lit(0.5))}
    parts = {"mean": stats["mean"], "std": stats["std"], "min": stats["min"], "max": stats["max"], "median": stats["median"]}
    out = df.withColumns({"__n": F.count(v).over(w), **{f"roll_{k}": c.over(w) for k, c in parts.items()}}).withColumn("roll_range", F.col("roll_max") - F.col("roll_min"))
    out = _own(out, chunk)
    if full:
        return out.filter(F.col("__n") == n).drop("__n")
    return out.withColumns({f"roll_{k}": F.when(F.col("__n") == n, F.col(f"roll_{k}")) for k in stats}).drop("__n")


def differences(df: DataFrame, key: str = "key", order: str = "seq", value: str = "f", chunk: int | None = None) -> DataFrame:
    """diff1, diff2 (second difference) and abs_diff; the first row of a key has none."""
    chunk = chunk or hot_chunk(df, 2, key)
    df, w = _spread(df, 2, chunk, key, order)
    one = df.withColumn("diff1", F.col(value) - F.lag(value).over(w))
    return _own(one.withColumns({"diff2": F.col("diff1") - F.lag("diff1").over(w), "abs_diff": F.abs("diff1")}), chunk)


def lags(df: DataFrame, by: Sequence[int] = (1, 5, 10, 20), key: str = "key", order: str = "seq", value: str = "f", chunk: int | None = None) -> DataFrame:
    """lag_n and lagdiff_n for every n; null where the key has no such row."""
    chunk = chunk or hot_chunk(df, max(by), key)
    df, w = _spread(df, max(by), chunk, key, order)
    out = _own(df.withColumns({f"lag_{n}": F.lag(value, n).over(w) for n in by}), chunk)
    return out.withColumns({f"lagdiff_{n}": F.col(value) - F.col(f"lag_{n}") for n in by})


def last_n(df: DataFrame, n: int, key: str = "key", order: str = "seq") -> DataFrame:
    """The n last rows of every key, ``back`` 1 for the last; the group limit is applied before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def stats(df: DataFrame, key: str = "key", value: str = "f", sample: bool = False) -> DataFrame:
    """count, mean, std (population, or sample), min, max."""
    std = F.stddev_samp(value) if sample else F.stddev_pop(value)
    return df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), std.alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def describe(df: DataFrame, key: str = "key", value: str = "f") -> DataFrame:
    """count, mean, sample std, min, quartiles (linear), max."""
    q = {f"p{p}": F.percentile(value, F.lit(p / 100)) for p in (25, 50, 75)}
    return df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), *[c.alias(k) for k, c in q.items()], F.max(value).alias("max"))


def trend(df: DataFrame, key: str = "key", order: str = "seq", value: str = "f") -> DataFrame:
    """Last value less the first."""
    return df.groupBy(key).agg((F.max_by(value, order) - F.min_by(value, order)).alias("trend"))


def zscore_anomalies(df: DataFrame, limit: float = 2.0, key: str = "key", value: str = "f") -> DataFrame:
    """Rows further than ``limit`` sample standard deviations from the key's mean.

    Mean and deviation come from an aggregation that is joined back, not from a window over the whole key: a hot key is
    combined on the map side.
    """
    s = df.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return df.join(s, key).withColumn("z", F.try_divide(F.col(value) - F.col("mean"), F.col("std"))).filter(F.abs(F.col(value) - F.col("mean")) > limit * F.col("std"))


def normalise(df: DataFrame, key: str = "key", value: str = "f", epsilon: float = 1e-8) -> DataFrame:
    """z = (x - mean) / (population std + epsilon), with the parameters kept for ``denormalise``."""
    s = df.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return df.join(s, key).withColumn("z", (F.col(value) - F.col("mean")) / (F.col("std") + epsilon))


def denormalise(df: DataFrame, epsilon: float = 1e-8) -> DataFrame:
    return df.withColumn("value", F.col("z") * (F.col("std") + epsilon) + F.col("mean"))


def drift(df: DataFrame, n: int = 50, jump: float = 0.5, shift: float = 0.3, key: str = "key", order: str = "seq", value: str = "f") -> DataFrame:
    """key, status of the last n values: OBSTACLE if any step exceeds ``jump``, else DRIFT if the halves' means differ by more than ``shift``, else OK; keys with fewer values are absent."""
    tail = last_n(df, n, key, order)
    w = Window.partitionBy(key).orderBy(F.desc("back"))
    steps = tail.withColumn("step", F.abs(F.col(value) - F.lag(value).over(w)))
    first, second = F.avg(F.when(F.col("back") > n // 2, F.col(value))), F.avg(F.when(F.col("back") <= n // 2, F.col(value)))
    a = steps.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("max_step"), (second - first).alias("mean_shift")).filter(F.col("n") >= n)
    return a.withColumn("status", F.when(F.col("max_step") > jump, "OBSTACLE").when(F.abs("mean_shift") > shift, "DRIFT").otherwise("OK"))


def downsample(df: DataFrame, n: int, key: str = "key", order: str = "seq", value: str = "f") -> DataFrame:
    """Means of blocks of n consecutive values; a short last block is dropped."""
    placed = number_in_keys(df, [key], [order], "__pos")
    blocks = placed.withColumn("block", F.floor(F.col("__pos") / n)).groupBy(key, "block").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return blocks.filter(F.col("n") == n).drop("n")


def resample(df: DataFrame, unit: str = "hour", keys: Sequence[str] = (), ts: str = "ts", value: str = "f", fill: bool = False) -> DataFrame:
    """Mean, min, max and count per calendar unit; fill: empty units between a key's first and last appear with nulls and count 0."""
    bins = df.groupBy(*keys, F.date_trunc(unit, ts).alias("bin")).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))
    if not fill:
        return bins
    step = F.expr(f"interval 1 {unit}")
    span = bins.groupBy(*keys).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).select(*keys, F.explode(F.sequence("lo", "hi", step)).alias("bin"))
    return span.join(bins, [*keys, "bin"], "left").fillna(0, ["n"])


def between_time(df: DataFrame, lo: str, hi: str, ts: str = "ts") -> DataFrame:
    """Rows whose time of day is within [lo, hi] (HH:mm:ss)."""
    return df.filter(F.date_format(ts, "HH:mm:ss").between(lo, hi))


def share_above(df: DataFrame, limit: float, keys: Sequence[str] = ("key",), value: str = "f") -> DataFrame:
    """count above the limit, total and percentage."""
    above = F.sum(F.when(F.col(value) > limit, 1).otherwise(0))
    return df.groupBy(*keys).agg(above.alias("above"), F.count(F.lit(1)).alias("total"), (100.0 * above / F.count(F.lit(1))).alias("percent"))


def correlation(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every pair of columns, in one pass: a, b, corr."""
    pairs = [(a, b) for n, a in enumerate(columns) for b in columns[n + 1 :]]
    one = df.groupBy(*keys).agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}~{b}`").alias("corr")) for a, b in pairs])
    return one.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def zip_series(df: DataFrame, names: Sequence[str], key: str = "key", order: str = "seq", value: str = "f", entity: str | None = None) -> DataFrame:
    """Aligns several series by position, as long as the shortest: pos and one column per name."""
    keys = [entity] if entity else []
    rows = number_in_keys(df.filter(F.col(key).isin(list(names))), [*keys, key], [order])
    wide = rows.groupBy(*keys, "pos").agg(*[F.max(F.when(F.col(key) == n, F.col(value))).alias(n) for n in names], F.countDistinct(key).alias("__k"))
    return wide.filter(F.col("__k") == len(names)).drop("__k")


def magnitude(df: DataFrame, axes: Sequence[str]) -> Column:
    """Length of the vector of the given columns."""
    total = F.lit(0.0)
    for a in axes:
        total = total + F.col(a) * F.col(a)
    return F.sqrt(total)


def sequences(df: DataFrame, length: int, ahead: int | None = 1, key: str = "key", order: str = "seq", value: str = "f") -> DataFrame:
    """Windows x[i .. i+length) as arrays, with the value ``ahead`` steps behind the window as y (None: windows alone)."""
    w = _by(key, order)
    out = df.withColumns({"x": F.collect_list(value).over(w.rowsBetween(0, length - 1)), "y": F.lead(value, length + (ahead or 1) - 1).over(w)})
    return out.filter((F.size("x") == length) & (F.lit(True) if ahead is None else F.col("y").isNotNull()))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, key: str = "key", order: str = "seq", value: str = "f", chunk: int | None = None) -> DataFrame:
    """signal 1 (buy) below mean - k sigma, -1 (sell) above mean + k sigma, else 0; full windows, the current row included."""
    chunk = chunk or hot_chunk(df, n - 1, key)
    df, by = _spread(df, n - 1, chunk, key, order)
    w = by.rowsBetween(-(n - 1), 0)
    out = _own(df.withColumns({"__n": F.count(value).over(w), "mid": F.avg(value).over(w), "sigma": F.stddev_pop(value).over(w)}), chunk).filter(F.col("__n") == n).drop("__n")
    v = F.col(value)
    return out.withColumn("signal", F.when(v < F.col("mid") - k * F.col("sigma"), 1).when(v > F.col("mid") + k * F.col("sigma"), -1).otherwise(0))


def crossover(df: DataFrame, short: int = 10, long: int = 20, key: str = "key", order: str = "seq", value: str = "f", chunk: int | None = None) -> DataFrame:
    """signal 1 where the short mean rises over the long one, -1 where it falls under it, else 0."""
    chunk = chunk or hot_chunk(df, long, key)
    df, w = _spread(df, long, chunk, key, order)
    ma = df.withColumns({"n": F.count(value).over(w.rowsBetween(-(long - 1), 0)), "ma_short": F.avg(value).over(w.rowsBetween(-(short - 1), 0)), "ma_long": F.avg(value).over(w.rowsBetween(-(long - 1), 0))}).filter(F.col("n") == long)
    p = ma.withColumns({"prev_short": F.lag("ma_short").over(w), "prev_long": F.lag("ma_long").over(w)})
    up = (F.col("prev_short") <= F.col("prev_long")) & (F.col("ma_short") > F.col("ma_long"))
    down = (F.col("prev_short") >= F.col("prev_long")) & (F.col("ma_short") < F.col("ma_long"))
    return _own(p.withColumn("signal", F.when(up, 1).when(down, -1).otherwise(0)).drop("n", "prev_short", "prev_long"), chunk)


def drawdown(df: DataFrame, key: str = "key", order: str = "seq", value: str = "f", chunk: int | None = None) -> DataFrame:
    """key, max_drawdown: the greatest fall from the running maximum, as a share of it.

    With ``chunk``: the maximum before a chunk comes from the chunks' maxima, so a hot key is many tasks.
    """
    chunk = chunk or hot_chunk(df, 1, key)
    if chunk is None:
        peak = F.max(value).over(_by(key, order).rowsBetween(Window.unboundedPreceding, 0))
        rows = df
    else:
        rows = number_in_keys(df, [key], [order], "__pos").withColumn("__chunk", F.floor(F.col("__pos") / chunk))
        tops = rows.groupBy(key, "__chunk").agg(F.max(value).alias("__top"))
        before = F.max("__top").over(_by(key, "__chunk").rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.join(tops.select(key, "__chunk", before.alias("__before")), [key, "__chunk"])
        inside = F.max(value).over(Window.partitionBy(key, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        peak = F.greatest(inside, "__before")
    return rows.withColumn("dd", F.try_divide(peak - F.col(value), peak)).groupBy(key).agg(F.max("dd").alias("max_drawdown"))


def trade(prices: np.ndarray, signals: np.ndarray, cash: float = 10_000.0) -> np.ndarray:
    """Equity after every step of an all-in, all-out account that follows buy (1) and sell (-1) signals."""
    held, equity = 0.0, np.empty(len(prices))
    for n, (p, s) in enumerate(zip(prices, signals)):
        if s > 0 and held == 0 and p > 0:
            held, cash = cash / p, 0.0
        elif s < 0 and held > 0:
            held, cash = 0.0, held * p
        equity[n] = cash + held * p
    return equity


def backtest(signals: DataFrame, cash: float = 10_000.0, key: str = "key", order: str = "seq", value: str = "f", strategy=None) -> DataFrame:
    """key, order, equity: a fold over each key's rows (``strategy`` may give the signals from the prices).

    The position depends on every row before, so each key is one task's sequence.
    """
    kinds = {f.name: f.dataType.simpleString() for f in signals.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        p = pdf[value].to_numpy(float)
        s = np.asarray(strategy(p)) if strategy else pdf["signal"].to_numpy()
        return pd.DataFrame({key: pdf[key].to_numpy(), order: pdf[order].to_numpy(), "equity": trade(p, s, cash)})

    cols = [key, order, value] + ([] if strategy else ["signal"])
    return signals.select(*cols).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, equity double")


def performance(equity: DataFrame, per_year: int = 252, key: str = "key", order: str = "seq") -> DataFrame:
    """total_return, volatility (yearly), sharpe, max_drawdown, win_rate of an equity curve."""
    w = _by(key, order)
    r = equity.withColumns({"ret": F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1, "peak": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    year = F.lit(float(per_year))
    return r.groupBy(key).agg(
        (F.try_divide(F.max_by("equity", order), F.min_by("equity", order)) - 1).alias("total_return"),
        (F.stddev_pop("ret") * F.sqrt(year)).alias("volatility"),
        F.when(F.stddev_pop("ret") > 0, F.try_divide(F.avg("ret"), F.stddev_pop("ret")) * F.sqrt(year)).otherwise(F.lit(0.0)).alias("sharpe"),
        F.max(F.try_divide(F.col("peak") - F.col("equity"), F.col("peak"))).alias("max_drawdown"),
        F.avg(F.when(F.col("ret") > 0, 1.0).when(F.col("ret") < 0, 0.0)).alias("win_rate"),
    )


def forecast_errors(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """mse, rmse, mae."""
    d = F.col(actual) - F.col(predicted)
    return df.groupBy(*keys).agg(F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def nearest_ranks(df: DataFrame, percents: Sequence[int], key: str = "key", value: str = "f") -> DataFrame:
    """The latency percentiles of a benchmark, p<n> per key: element floor(n * p / 100) of the sorted values (the last, if beyond).

    Values are numbered range by range, so a hot key is not gathered anywhere.
    """
    known = df.select(key, value).filter(F.col(value).isNotNull())
    numbered = number_in_keys(known, [key], [value], "__pos").join(known.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), key)
    at = {p: F.least(F.floor(F.col("__n") * p / 100), F.col("__n") - 1) for p in percents}
    return numbered.groupBy(key).agg(*[F.max(F.when(F.col("__pos") == at[p], F.col(value))).alias(f"p{p}") for p in percents])


def chunked(df: DataFrame, back: int, rows: int, key: str = "key", order: str = "seq") -> DataFrame:
    """Cuts every key's rows into chunks of ``rows``, each preceded by copies (``__ghost``) of the ``back`` rows before it.

    A window that looks back at most ``back`` rows then gives the same over (key, __chunk), and a hot key is many tasks.
    """
    if back >= rows:
        raise ValueError("a chunk has more rows than a window looks back")
    numbered = number_in_keys(df, [key], [order], "__pos")
    own, place = F.floor(F.col("__pos") / rows), F.col("__pos") % rows
    both = F.when(place >= rows - back, F.array(own, own + 1)).otherwise(F.array(own))
    return numbered.withColumn("__chunk", F.explode(both)).withColumn("__ghost", F.col("__chunk") != F.floor(F.col("__pos") / rows))


HOT_ROWS = 1_000_000


def hot_chunk(df: DataFrame, back: int, key: str = "key", limit: int | None = None) -> int | None:
    """Rows of a chunk, if some key has more than ``limit`` rows (counted, combined on the map side); else None: each key is one task's sort."""
    limit = limit or HOT_ROWS
    most = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return max(limit // 2, 4 * back) if most > limit else None


def _spread(df: DataFrame, back: int, rows: int | None, key: str, order: str):
    """(rows, window) for windows that look back ``back`` rows; with ``rows``, in chunks."""
    if rows is None:
        return df, _by(key, order)
    return chunked(df, back, rows, key, order), Window.partitionBy(key, "__chunk").orderBy(order)


def _own(df: DataFrame, rows: int | None) -> DataFrame:
    return df if rows is None else df.filter("not __ghost").drop("__pos", "__chunk", "__ghost")


def auto_step(points: DataFrame, keys: Sequence[str], order: str, step: str = "step", rows: int = 500_000) -> DataFrame:
    """Fills null steps: one more than the step before (explicit or counted), 0 for the first.

    Points are numbered by ranges, and the last explicit step before each chunk of ``rows`` points comes from the chunks', so a hot key is many tasks.
    """
    placed = number_in_keys(points, list(keys), [order], "__pos").withColumn("__chunk", F.floor(F.col("__pos") / rows))
    placed = placed.withColumn("__given", F.when(F.col(step).isNotNull(), F.struct("__pos", F.col(step).cast("bigint").alias("step"))))
    tops = placed.groupBy(*keys, "__chunk").agg(F.max("__given").alias("__top"))
    before = F.max("__top").over(Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))  # one row a chunk
    tops = tops.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__chunk").alias("__of"), before.alias("__before"))
    on = F.col("__chunk") == F.col("__of")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = F.max("__given").over(Window.partitionBy(*keys, "__chunk").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0))
    last = placed.join(tops, on).withColumn("__last", F.coalesce(inside, "__before"))
    counted = F.coalesce(F.col("__last.step") + F.col("__pos") - F.col("__last.__pos"), F.col("__pos"))
    return last.withColumn(step, counted.cast("bigint")).select(*points.columns)
