"""General analytics over the star schema: aggregation, joins, windows and sessions, as Catalyst plans."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of line items by return flag and status, of all but the last months' shipments."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n_lines"))
    )


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of the lines whose customer and supplier are of one nation."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(customers, "o_custkey")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("c_nationkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return lines.join(orders, "l_orderkey").join(suppliers, ["l_suppkey", "c_nationkey"]).join(nations, "c_nationkey").groupBy("n_name").agg(F.round(F.sum("net"), 2).alias("revenue"), F.count("*").alias("n_lines"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's three dearest orders; ties go to the lower key."""
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", rank.alias("place")).filter("place <= 3")


def user_sessions(spark: SparkSession, sf_dir: str, gap_minutes: int = 30) -> DataFrame:
    """Sessions of events by user: a pause of over `gap_minutes` ends one."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    begins = F.when(seconds - F.lag(seconds).over(by_user) <= gap_minutes * 60, 0).otherwise(1)
    numbered = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", begins.alias("begins")).withColumn("session", F.sum("begins").over(by_user))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total_value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pricing_summary": pricing_summary, "revenue_by_nation": revenue_by_nation, "top_orders": top_orders, "user_sessions": user_sessions,
}

ORACLES = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net,
               round(avg(l_discount), 6) AS avg_discount, count(*) AS n_lines
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "revenue_by_nation": """
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "top_orders": """
        SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place
        FROM orders QUALIFY place <= 3""",
    "user_sessions": """
        WITH e AS (SELECT user_id, event_id, ts, value, CASE WHEN floor(epoch(ts)) - lag(floor(epoch(ts))) OVER w <= 1800 THEN 0 ELSE 1 END AS begins
                   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
             s AS (SELECT *, CAST(sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM e)
        SELECT user_id, session, count(*) AS n_events, round(sum(value), 4) AS total_value FROM s GROUP BY ALL""",
}
