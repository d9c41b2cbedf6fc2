"""Registered queries of general relational shapes on the star tables and of event windows, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexforge.session import table
from lexforge.streaming import events as E


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= "1998-09-02")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def semi_join_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(big, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def anti_join_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def left_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))  # before the join
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return c.join(per, c["c_custkey"] == per["o_custkey"], "left").groupBy("c_nationkey").agg(F.sum(F.coalesce("n", F.lit(0))).alias("orders"), F.count_if(F.col("n").isNull()).alias("without"))


def full_join_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full").select("k", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"intersect": c.intersect(s), "except": c.filter("k > 3").subtract(s.filter("k > 10")), "union": c.union(s).distinct()}
    out = None
    for name, p in parts.items():
        one = p.select(F.lit(name).alias("op"), "k")
        out = one if out is None else out.unionByName(one)
    return out


def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.Window.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(order)).filter("r <= 5").select("o_orderpriority", "o_orderkey", "o_totalprice", F.col("r").cast("long").alias("r"))


def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).na.fill(0)


def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    per_order = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    own = t("orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = own.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name", "n_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("n"))


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache's upsert: of each user the latest event."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))


def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return E.tumbling(e, "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.sessions(table(spark, sf_dir, "events"))
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def events_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which a user had an event of a type."""
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    return E.deduplicated(e, ["user_id", "event_type", "hour"]).groupBy("event_type").agg(F.count("*").alias("n"))


def json_field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").getField("k").alias("k"))
    return e.groupBy("event_type").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.round(F.avg("k"), 6).alias("mean"), F.percentile("k", F.lit(0.9)).alias("p90"))


QUERIES = {f.__name__: f for f in (pricing_summary, semi_join_orders, anti_join_customers, left_join_counts, full_join_series, set_operations, topk_per_group, pivot_status, star_join, latest_per_key, events_tumbling, events_session, events_dedup, json_field_stats)}
ORACLES = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "semi_join_orders": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1",
    "anti_join_customers": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "left_join_counts": "SELECT c_nationkey, coalesce(sum(n), 0)::BIGINT AS orders, count(*) FILTER (n IS NULL) AS without FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1",
    "full_join_series": "SELECT coalesce(a.k, b.k) AS k, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 0 GROUP BY 1) b ON a.k = b.k",
    "set_operations": "SELECT 'intersect' AS op, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_nationkey > 3 EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 10) UNION ALL SELECT 'union', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)",
    "topk_per_group": "SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 5",
    "pivot_status": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
    "star_join": "SELECT r_name, n_name, round(sum(revenue), 2) AS revenue, count(*) AS n FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL",
    "latest_per_key": "SELECT user_id, (max(struct_pack(t := ts, e := event_id))).e AS event_id, count(*) AS n FROM events GROUP BY 1",
    "events_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_session": "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k",
    "events_dedup": "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS h FROM events) GROUP BY 1",
    "json_field_stats": "SELECT event_type, min(k) AS lo, max(k) AS hi, round(avg(k), 6) AS mean, quantile_cont(k, 0.9) AS p90 FROM (SELECT event_type, (props->>'$.k')::INT AS k FROM events) GROUP BY 1",
}
