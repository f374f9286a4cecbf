"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.operators import window
from sparrel.plans.catalogue import query, same
from sparrel.session import load

same("row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS n FROM {orders}")
same("rank_dense", "SELECT l_orderkey, l_linenumber, CAST(rank() OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY l_quantity) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY l_quantity) AS BIGINT) AS d FROM {lineitem}")
same("ntile", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS q FROM {customer}", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS q FROM customer")
same("lag_lead", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0D) OVER w AS later FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
same("first_last_nth", "SELECT o_orderkey, first_value(o_totalprice) OVER w AS a, last_value(o_totalprice) OVER w AS b, nth_value(o_totalprice, 2) OVER w AS c FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
same("percent_rank_cume_dist", "SELECT s_suppkey, round(percent_rank() OVER w, 8) AS p, round(cume_dist() OVER w, 8) AS c FROM {supplier} WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal)")
same("win_rows", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM {orders}")
same("win_range", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_custkey RANGE BETWEEN 50 PRECEDING AND 100 FOLLOWING) AS n FROM {customer}")
same("win_running_sum", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts) AS n, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS s FROM {events}")
same("win_filter", "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n FROM {orders}".replace("count(*) FILTER (WHERE o_orderstatus = 'F')", "count(CASE WHEN o_orderstatus = 'F' THEN 1 END)"), "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n FROM orders")
same("win_over_groups_of_rows", "SELECT o_custkey, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS BIGINT) AS r FROM {orders} GROUP BY o_custkey")
same("win_bool_bit_stddev", "SELECT s_suppkey, bool_and(s_acctbal > 0) OVER w AS a, bit_or(s_suppkey) OVER w AS b, round(stddev_pop(s_acctbal) OVER w, 4) AS d FROM {supplier} WINDOW w AS (PARTITION BY s_nationkey)")


@query("SELECT p_partkey, count(*) OVER w AS n, CAST(sum(p_size) OVER w AS BIGINT) AS s, CAST(max(p_size) OVER w AS INTEGER) AS m FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
def win_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = window.over_groups(load(spark, sf_dir, "part"), ["p_brand"], [F.col("p_size")], -2, 1, n=F.count("*"), s=F.sum("p_size"), m=F.max("p_size"))
    return out.select("p_partkey", "n", "s", "m")


def _excluding(exclude: str) -> None:
    frame = f"(PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE {exclude.upper()})"
    name = f"win_exclude_{exclude.replace(' ', '_')}"

    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = load(spark, sf_dir, "part")
        out = window.over_excluding(p, ["p_brand"], [F.col("p_size"), F.col("p_partkey")], [], -3, 2, exclude, "p_size", "sum", "count", "min", "max")
        return out.select("p_partkey", F.col("sum").cast("bigint").alias("s"), F.col("count").cast("bigint").alias("n"), F.col("min").alias("lo"), F.col("max").alias("hi"))

    plan.__name__ = name
    query(f"SELECT p_partkey, CAST(sum(p_size) OVER w AS BIGINT) AS s, count(p_size) OVER w AS n, min(p_size) OVER w AS lo, max(p_size) OVER w AS hi FROM part WINDOW w AS {frame}")(plan)


for _exclude in ("current row", "group", "ties", "no others"):
    _excluding(_exclude)
