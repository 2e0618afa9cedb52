"""Time series queries over the events table: one series per user, or per event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.times import epoch_seconds
from emberlog.operators import series as S
from emberlog.sources.tables import table


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("value").alias("f"), "ts", "event_type")


def by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.col("value").alias("f"), "ts", F.col("user_id"))


def ts_rolling(spark, d):
    return S.rolling(by_user(spark, d), 10).select("key", "seq", "roll_mean", "roll_std", "roll_min", "roll_max", "roll_range", "roll_median")


def ts_rolling_hot(spark, d):
    """The same windows over few, long series, in chunks."""
    return S.rolling(by_type(spark, d), 20, chunk=500).select("key", "seq", "roll_mean", "roll_max")


def ts_lag_hot(spark, d):
    return S.lags(by_type(spark, d), (1, 10), chunk=300).select("key", "seq", "lag_1", "lag_10")


def ts_drawdown_hot(spark, d):
    return S.drawdown(by_type(spark, d), chunk=100)


def ts_ma_cross_hot(spark, d):
    return S.crossover(by_type(spark, d), chunk=250).select("key", "seq", "ma_short", "ma_long", "signal")


def ts_rolling_padded(spark, d):
    return S.rolling(by_user(spark, d), 12, full=False).select("key", "seq", "roll_mean")


def ts_diff(spark, d):
    return S.differences(by_user(spark, d)).select("key", "seq", "diff1", "diff2", "abs_diff")


def ts_lag(spark, d):
    return S.lags(by_user(spark, d)).select("key", "seq", *[f"{a}_{n}" for a in ("lag", "lagdiff") for n in (1, 5, 10, 20)])


def ts_last_n(spark, d):
    return S.last_n(by_user(spark, d), 3).select("key", "back", "seq", "f")


def ts_stats(spark, d):
    return S.stats(by_user(spark, d))


def ts_describe(spark, d):
    return S.describe(by_user(spark, d))


def ts_trend(spark, d):
    return S.trend(by_user(spark, d))


def ts_zscore_anomaly(spark, d):
    return S.zscore_anomalies(by_user(spark, d)).select("key", "seq", "f", "z")


def ts_normalize(spark, d):
    return S.normalise(by_user(spark, d)).select("key", "seq", "z")


def ts_denormalize(spark, d):
    return S.denormalise(S.normalise(by_user(spark, d))).select("key", "seq", "value")


def ts_drift(spark, d):
    return S.drift(by_user(spark, d), jump=150.0, shift=5.0)


def ts_downsample(spark, d):
    return S.downsample(by_user(spark, d), 7).select("key", "block", "mean")


def ts_resample_hour(spark, d):
    return S.resample(by_type(spark, d), "hour", ["key"]).select("key", epoch_seconds("bin").alias("bin"), "mean", "min", "max", "n")


def ts_resample_filled(spark, d):
    return S.resample(by_type(spark, d), "hour", ["key"], fill=True).select("key", epoch_seconds("bin").alias("bin"), "mean", "n")


def ts_between_time(spark, d):
    return S.between_time(by_user(spark, d), "06:00:00", "12:00:00").select("key", "seq", "f")


def ts_time_range(spark, d):
    e = by_user(spark, d).filter((F.col("ts") >= F.lit("2024-01-05 10:00:00").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-05 14:00:00").cast("timestamp_ntz")))
    return e.select("key", "seq", "f")


def ts_share_above(spark, d):
    return S.share_above(by_type(spark, d), 24.0)


def ts_corr(spark, d):
    e = by_type(spark, d).withColumns({"a": F.col("f"), "b": (F.col("seq") % 101).cast("double"), "c": (F.col("user_id") % 13).cast("double")})
    return S.correlation(e, ["a", "b", "c"], ["key"])


def ts_argmax(spark, d):
    m = by_user(spark, d).groupBy("key").agg(F.avg("f").alias("m"))
    return m.agg(F.max_by("key", F.struct("m", "key")).alias("warmest"), F.min_by("key", F.struct("m", "key")).alias("coldest"))


def ts_zip(spark, d):
    return S.zip_series(by_type(spark, d), ["click", "view", "error"], entity="user_id").withColumn("length", S.magnitude(None, ["click", "view", "error"])).select("user_id", "pos", "click", "view", "error", "length")


def ts_sequences(spark, d):
    return S.sequences(by_user(spark, d), 5).select("key", "seq", F.aggregate("x", F.lit(0.0), lambda a, x: a + x).alias("x_sum"), "y")


def ts_bollinger(spark, d):
    return S.bollinger(by_user(spark, d)).select("key", "seq", "mid", "sigma", "signal")


def ts_ma_cross(spark, d):
    return S.crossover(by_user(spark, d)).select("key", "seq", "ma_short", "ma_long", "signal")


def ts_drawdown(spark, d):
    return S.drawdown(by_user(spark, d))


def ts_backtest(spark, d):
    return S.performance(S.backtest(S.crossover(by_user(spark, d))))


def ts_backtest_buy_and_hold(spark, d):
    """The account of each event type that buys at the first value and never sells."""
    held = S.backtest(by_type(spark, d).filter("f > 0").withColumn("signal", F.lit(1)))
    return S.performance(held).select("key", "total_return", "max_drawdown")


def ts_forecast_errors(spark, d):
    e = S.lags(by_user(spark, d), [1]).filter("lag_1 is not null")
    return S.forecast_errors(e, "f", "lag_1", ["key"])


def ts_latency(spark, d):
    return S.nearest_ranks(by_type(spark, d), (50, 95, 99))


def ts_threshold_p99(spark, d):
    limit = by_type(spark, d).groupBy("key").agg(F.percentile("f", F.lit(0.99)).alias("limit"))
    return by_type(spark, d).join(limit, "key").filter("f > limit").select("key", "seq", "f")


def metric_auto_step(spark, d):
    points = by_user(spark, d).withColumn("step", F.when(F.col("seq") % 9 == 4, F.col("seq") % 50))
    return S.auto_step(points, ["key"], "seq").select("key", "seq", "step")


def ts_hourly_rollup(spark, d):
    """Counts and sums per hour and type, kept as a table from which coarser units are made."""
    hourly = by_type(spark, d).groupBy("key", F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("s"))
    return hourly.groupBy("key", F.date_trunc("day", "h").alias("day")).agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("total")).select("key", epoch_seconds("day").alias("day"), "n", "total")


def wide_pivot(spark, d):
    from emberlog.sources.frames import to_wide

    wide = to_wide(by_type(spark, d), ["click", "error", "view"])
    return wide.select("pos", "click", "error", "view")


QUERIES = {k: f for k, f in globals().items() if k.startswith(("ts_", "metric_", "wide_")) and callable(f)}

_U = "WITH s AS (SELECT user_id AS key, event_id AS seq, value AS f, ts, event_type FROM events)\n"
_T = "WITH s AS (SELECT event_type AS key, event_id AS seq, value AS f, ts, user_id FROM events)\n"
_W = "OVER (PARTITION BY key ORDER BY seq"
_LAGS = ", ".join(f"lag(f, {n}) {_W}) AS lag_{n}, f - lag(f, {n}) {_W}) AS lagdiff_{n}" for n in (1, 5, 10, 20))
ORACLE = {
    "ts_rolling": _U + f"""SELECT key, seq, roll_mean, roll_std, roll_min, roll_max, roll_max - roll_min AS roll_range, roll_median FROM (SELECT key, seq, count(*) {_W} ROWS 9 PRECEDING) AS n, avg(f) {_W} ROWS 9 PRECEDING) AS roll_mean,
 stddev_pop(f) {_W} ROWS 9 PRECEDING) AS roll_std, min(f) {_W} ROWS 9 PRECEDING) AS roll_min, max(f) {_W} ROWS 9 PRECEDING) AS roll_max, median(f) {_W} ROWS 9 PRECEDING) AS roll_median FROM s) WHERE n = 10""",
    "ts_rolling_hot": _T + f"SELECT key, seq, m AS roll_mean, x AS roll_max FROM (SELECT key, seq, count(*) {_W} ROWS 19 PRECEDING) AS n, avg(f) {_W} ROWS 19 PRECEDING) AS m, max(f) {_W} ROWS 19 PRECEDING) AS x FROM s) WHERE n = 20",
    "ts_lag_hot": _T + f"SELECT key, seq, lag(f, 1) {_W}) AS lag_1, lag(f, 10) {_W}) AS lag_10 FROM s",
    "ts_rolling_padded": _U + f"SELECT key, seq, CASE WHEN count(*) {_W} ROWS 11 PRECEDING) = 12 THEN avg(f) {_W} ROWS 11 PRECEDING) END AS roll_mean FROM s",
    "ts_diff": _U + f"SELECT key, seq, diff1, diff1 - lag(diff1) {_W}) AS diff2, abs(diff1) AS abs_diff FROM (SELECT *, f - lag(f) {_W}) AS diff1 FROM s)",
    "ts_lag": _U + f"SELECT key, seq, {_LAGS} FROM s",
    "ts_last_n": _U + "SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS back, seq, f FROM s QUALIFY back <= 3",
    "ts_stats": _U + "SELECT key, count(f) AS n, avg(f) AS mean, stddev_pop(f) AS std, min(f) AS min, max(f) AS max FROM s GROUP BY key",
    "ts_describe": _U + "SELECT key, count(f) AS n, avg(f) AS mean, stddev_samp(f) AS std, min(f) AS min, quantile_cont(f, 0.25) AS p25, quantile_cont(f, 0.5) AS p50, quantile_cont(f, 0.75) AS p75, max(f) AS max FROM s GROUP BY key",
    "ts_trend": _U + "SELECT key, arg_max(f, seq) - arg_min(f, seq) AS trend FROM s GROUP BY key",
    "ts_zscore_anomaly": _U + "SELECT key, seq, f, (f - m) / sd AS z FROM (SELECT *, avg(f) OVER (PARTITION BY key) AS m, stddev_samp(f) OVER (PARTITION BY key) AS sd FROM s) WHERE abs(f - m) > 2 * sd",
    "ts_normalize": _U + "SELECT key, seq, (f - avg(f) OVER (PARTITION BY key)) / (stddev_pop(f) OVER (PARTITION BY key) + 1e-8) AS z FROM s",
    "ts_denormalize": _U + "SELECT key, seq, f AS value FROM s",
    "ts_drift": _U + f""", t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS back FROM s QUALIFY back <= 50),
u AS (SELECT *, abs(f - lag(f) {_W})) AS step FROM t),
a AS (SELECT key, count(*) AS n, max(step) AS max_step, avg(f) FILTER (back <= 25) - avg(f) FILTER (back > 25) AS mean_shift FROM u GROUP BY key)
SELECT *, CASE WHEN max_step > 150 THEN 'OBSTACLE' WHEN abs(mean_shift) > 5 THEN 'DRIFT' ELSE 'OK' END AS status FROM a WHERE n >= 50""",
    "ts_downsample": _U + f"SELECT key, block, avg(f) AS mean FROM (SELECT *, (row_number() {_W}) - 1) // 7 AS block FROM s) GROUP BY key, block HAVING count(*) = 7",
    "ts_resample_hour": _T + "SELECT key, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS bin, avg(f) AS mean, min(f) AS min, max(f) AS max, count(f) AS n FROM s GROUP BY 1, 2",
    "ts_resample_filled": _T + """, b AS (SELECT key, date_trunc('hour', ts) AS bin, avg(f) AS mean, count(f) AS n FROM s GROUP BY 1, 2),
g AS (SELECT key, unnest(range(min(bin), max(bin) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS bin FROM b GROUP BY key)
SELECT g.key, epoch_us(g.bin) // 1000000 AS bin, b.mean, coalesce(b.n, 0) AS n FROM g LEFT JOIN b USING (key, bin)""",
    "ts_between_time": _U + "SELECT key, seq, f FROM s WHERE strftime(ts, '%H:%M:%S') BETWEEN '06:00:00' AND '12:00:00'",
    "ts_time_range": _U + "SELECT key, seq, f FROM s WHERE ts >= TIMESTAMP '2024-01-05 10:00:00' AND ts < TIMESTAMP '2024-01-05 14:00:00'",
    "ts_share_above": _T + "SELECT key, sum((f > 24)::INT) AS above, count(*) AS total, 100.0::DOUBLE * sum((f > 24)::INT) / count(*) AS percent FROM s GROUP BY key",
    "ts_corr": _T + """, x AS (SELECT key, f AS a, (seq % 101)::DOUBLE AS b, (user_id % 13)::DOUBLE AS c FROM s)
SELECT key, 'a' AS a, 'b' AS b, corr(a, b) AS corr FROM x GROUP BY key UNION ALL SELECT key, 'a', 'c', corr(a, c) FROM x GROUP BY key UNION ALL SELECT key, 'b', 'c', corr(b, c) FROM x GROUP BY key""",
    "ts_argmax": _U + ", m AS (SELECT key, avg(f) AS m FROM s GROUP BY key) SELECT arg_max(key, (m, key)) AS warmest, arg_min(key, (m, key)) AS coldest FROM m",
    "ts_zip": _T + """, p AS (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY seq) - 1 AS pos FROM s)
SELECT a.user_id, a.pos, a.f AS click, b.f AS view, c.f AS error, sqrt(a.f * a.f + b.f * b.f + c.f * c.f) AS length FROM p a JOIN p b USING (user_id, pos) JOIN p c USING (user_id, pos) WHERE a.key = 'click' AND b.key = 'view' AND c.key = 'error'""",
    "ts_sequences": _U + f"SELECT key, seq, x_sum, y FROM (SELECT key, seq, sum(f) {_W} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS x_sum, lead(f, 5) {_W}) AS y FROM s) WHERE y IS NOT NULL",
    "ts_bollinger": _U + f"""SELECT key, seq, mid, sigma, CASE WHEN f < mid - 2 * sigma THEN 1 WHEN f > mid + 2 * sigma THEN -1 ELSE 0 END AS signal
FROM (SELECT *, count(*) {_W} ROWS 19 PRECEDING) AS n, avg(f) {_W} ROWS 19 PRECEDING) AS mid, stddev_pop(f) {_W} ROWS 19 PRECEDING) AS sigma FROM s) WHERE n = 20""",
    "ts_ma_cross": _U + f""", m AS (SELECT *, count(*) {_W} ROWS 19 PRECEDING) AS n, avg(f) {_W} ROWS 9 PRECEDING) AS ma_short, avg(f) {_W} ROWS 19 PRECEDING) AS ma_long FROM s),
k AS (SELECT *, lag(ma_short) {_W}) AS ps, lag(ma_long) {_W}) AS pl FROM m WHERE n = 20)
SELECT key, seq, ma_short, ma_long, CASE WHEN ps <= pl AND ma_short > ma_long THEN 1 WHEN ps >= pl AND ma_short < ma_long THEN -1 ELSE 0 END AS signal FROM k""",
    "ts_drawdown_hot": _T + f"SELECT key, max((peak - f) / peak) AS max_drawdown FROM (SELECT *, max(f) {_W}) AS peak FROM s) GROUP BY key",
    "ts_ma_cross_hot": _T + f""", m AS (SELECT *, count(*) {_W} ROWS 19 PRECEDING) AS n, avg(f) {_W} ROWS 9 PRECEDING) AS ma_short, avg(f) {_W} ROWS 19 PRECEDING) AS ma_long FROM s),
k AS (SELECT *, lag(ma_short) {_W}) AS ps, lag(ma_long) {_W}) AS pl FROM m WHERE n = 20)
SELECT key, seq, ma_short, ma_long, CASE WHEN ps <= pl AND ma_short > ma_long THEN 1 WHEN ps >= pl AND ma_short < ma_long THEN -1 ELSE 0 END AS signal FROM k""",
    "ts_drawdown": _U + f"SELECT key, max((peak - f) / peak) AS max_drawdown FROM (SELECT *, max(f) {_W}) AS peak FROM s) GROUP BY key",
    "ts_backtest_buy_and_hold": _T + f"""SELECT key, arg_max(f, seq) / arg_min(f, seq) - 1 AS total_return, max((peak - f) / peak) AS max_drawdown FROM (SELECT *, max(f) {_W}) AS peak FROM s WHERE f > 0) GROUP BY key""",
    "ts_forecast_errors": _U + f"SELECT key, avg(d * d) AS mse, sqrt(avg(d * d)) AS rmse, avg(abs(d)) AS mae FROM (SELECT key, f - lag(f) {_W}) AS d FROM s) WHERE d IS NOT NULL GROUP BY key",
    "ts_latency": _T + "SELECT key, " + ", ".join(f"list_sort(list(f))[least(floor(count(*) * {p} / 100)::INT, count(*) - 1) + 1] AS p{p}" for p in (50, 95, 99)) + " FROM s GROUP BY key",
    "ts_threshold_p99": _T + "SELECT key, seq, f FROM s JOIN (SELECT key, quantile_cont(f, 0.99) AS l FROM s GROUP BY key) USING (key) WHERE f > l",
    "metric_auto_step": _U + f""", p AS (SELECT *, CASE WHEN seq % 9 = 4 THEN seq % 50 END AS step, count(CASE WHEN seq % 9 = 4 THEN 1 END) {_W}) AS run FROM s),
q AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY seq) AS n, max(step) OVER (PARTITION BY key, run) AS base FROM p)
SELECT key, seq, CASE WHEN run = 0 THEN n - 1 ELSE base + n - 1 END AS step FROM q""",
    "ts_hourly_rollup": _T + "SELECT key, epoch_us(date_trunc('day', ts)::TIMESTAMP) // 1000000 AS day, count(*) AS n, round(sum(f), 2) AS total FROM s GROUP BY 1, 2",
    "wide_pivot": _T + """, p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS pos FROM s WHERE key IN ('click', 'error', 'view'))
SELECT pos, max(f) FILTER (key = 'click') AS click, max(f) FILTER (key = 'error') AS error, max(f) FILTER (key = 'view') AS view FROM p GROUP BY pos""",
}
