"""Relational breadth over the star schema: aggregates, grouping sets, joins of every kind, set operations, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlog.sources.tables import table


def agg_category(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("avg_quantity"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.round(F.sum("l_extendedprice"), 2).alias("revenue")).orderBy(F.desc("n"), "l_returnflag", "l_linestatus")


def agg_pricing_summary(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.sum(disc * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.count(F.lit(1)).alias("n"))


def agg_rollup(spark, d):
    o = table(spark, d, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def agg_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def agg_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


def agg_approx_distinct(spark, d):
    """Relative error of the sketch, as a yes or no: within three standard errors of the exact count."""
    a = table(spark, d, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.countDistinct("l_partkey").alias("e"))
    return a.select((F.abs(F.col("a") - F.col("e")) <= 0.06 * F.col("e")).alias("close"))


def agg_argmax(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("top_order"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("low_order"))


def join_nation_revenue(spark, d):
    li, o, c = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def join_outer(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


def join_full(spark, d):
    s, c = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers")), table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return s.join(c, s.s_nationkey == c.c_nationkey, "full").select(F.coalesce("s_nationkey", "c_nationkey").alias("nation"), "suppliers", "customers")


def join_semi(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


def join_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


def join_range(spark, d):
    """Events within an hour before a purchase of the same user: the hour's bucket is an equi-key, the range a residual."""
    e = table(spark, d, "events")
    hour = F.date_trunc("hour", "ts")
    p = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("at"), F.explode(F.array(hour, hour - F.expr("interval 1 hour"))).alias("h"))
    x = e.filter("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("event"), "ts", hour.alias("h"))
    near = (F.col("ts") <= F.col("at")) & (F.col("ts") > F.col("at") - F.expr("interval 1 hour"))
    return p.join(x, ["user_id", "h"]).filter(near).select("purchase", "event")


def set_union(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")).distinct()


def set_intersect(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return c.intersect(o)


def set_except(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return c.subtract(o)


def set_except_all(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id").exceptAll(e.filter("event_type = 'view'").select("user_id"))


def window_ranks(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    r = table(spark, d, "customer").select("c_custkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.ntile(4).over(w).alias("quartile"), F.lead("c_custkey").over(w).alias("next"))
    return r.filter("rank <= 5")


def top_limit(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


def top_per_group(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("p_brand", "p_partkey", "r")


def sql_entry(spark, d):
    """The same engine by SQL text, over views of this session."""
    o = table(spark, d, "orders")
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM {o} WHERE o_totalprice > 1000 GROUP BY o_orderstatus", o=o)


QUERIES = {k: f for k, f in globals().items() if k.startswith(("agg_", "join_", "set_", "window_", "top_", "sql_")) and callable(f)}

_URGENT = "(SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"
ORACLE = {
    "agg_category": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS avg_quantity, round(avg(l_discount), 6) AS avg_discount, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY ALL",
    "agg_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1",
    "agg_approx_distinct": "SELECT true AS close",
    "agg_argmax": "SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top_order, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS low_order FROM orders GROUP BY 1",
    "join_nation_revenue": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "join_outer": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "join_full": "SELECT coalesce(s_nationkey, c_nationkey) AS nation, suppliers, customers FROM (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) FULL JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) ON s_nationkey = c_nationkey",
    "join_semi": f"SELECT c_custkey FROM customer WHERE c_custkey IN {_URGENT}",
    "join_anti": f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN {_URGENT}",
    "join_range": "SELECT p.event_id AS purchase, x.event_id AS event FROM events p JOIN events x ON p.user_id = x.user_id AND x.ts <= p.ts AND x.ts > p.ts - INTERVAL 1 HOUR WHERE p.event_type = 'purchase' AND x.event_type <> 'purchase'",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "set_except_all": "SELECT user_id FROM events EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'view'",
    "window_ranks": "SELECT * FROM (SELECT c_custkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER w AS quartile, lead(c_custkey) OVER w AS next FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)) WHERE rank <= 5",
    "top_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "top_per_group": "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part QUALIFY r <= 3",
    "sql_entry": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1",
}
