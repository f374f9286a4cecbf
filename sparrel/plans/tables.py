"""DML as functions, constraints, partitions, statistics, user-defined functions, changes, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.operators import dml
from sparrel.operators.dml import When
from sparrel.plans.catalogue import query
from sparrel.session import load
from sparrel.stored import folder


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    s = t.filter("s_suppkey % 2 = 0").select((F.col("s_suppkey") + 10).alias("s_suppkey"), F.col("s_nationkey"), (F.col("s_acctbal") + 1000).alias("s_acctbal"))
    return t, s


_SOURCE = "(SELECT s_suppkey + 10 AS s_suppkey, s_nationkey, s_acctbal + 1000 AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0)"


@query(f"""SELECT coalesce(t.s_suppkey, s.s_suppkey) AS s_suppkey, CASE WHEN t.s_suppkey IS NULL THEN s.s_nationkey ELSE t.s_nationkey END AS s_nationkey, round(CASE WHEN t.s_suppkey IS NULL THEN s.s_acctbal WHEN s.s_suppkey IS NULL THEN t.s_acctbal ELSE s.s_acctbal END, 2) AS s_acctbal
FROM supplier t FULL JOIN {_SOURCE} s ON t.s_suppkey = s.s_suppkey WHERE NOT (t.s_suppkey IS NOT NULL AND s.s_suppkey IS NOT NULL AND t.s_nationkey > 20) AND NOT (s.s_suppkey IS NULL AND t.s_suppkey % 5 = 0)""")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _changes(spark, sf_dir)
    c = F.col
    whens = [
        When(True, "delete", c("t.s_nationkey") > 20), When(True, "update", None, {"s_acctbal": c("s.s_acctbal")}),
        When(False, "insert", None, {k: c(f"s.{k}") for k in t.columns}), When("source", "delete", c("t.s_suppkey") % 5 == 0),
    ]
    new, _ = dml.merge(t, s, ["s_suppkey"], whens)
    return new.withColumn("s_acctbal", F.round("s_acctbal", 2))


@query(f"SELECT CASE WHEN t.s_suppkey IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS merge_action, count(*) AS n FROM supplier t RIGHT JOIN {_SOURCE} s ON t.s_suppkey = s.s_suppkey GROUP BY 1")
def merge_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _changes(spark, sf_dir)
    whens = [When(True, "update", None, {"s_acctbal": F.col("s.s_acctbal")}), When(False, "insert", None, {k: F.col(f"s.{k}") for k in t.columns})]
    _, acts = dml.merge(t, s, ["s_suppkey"], whens)
    return acts.groupBy("merge_action").agg(F.count("*").alias("n"))


@query(f"SELECT s_suppkey, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_nationkey, round(s_acctbal, 2) FROM {_SOURCE} WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def on_conflict_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _changes(spark, sf_dir)
    return dml.upsert(t, s, ["s_suppkey"]).withColumn("s_acctbal", F.round("s_acctbal", 2))


@query(f"SELECT coalesce(t.s_suppkey, s.s_suppkey) AS s_suppkey, coalesce(t.s_nationkey, s.s_nationkey) AS s_nationkey, round(CASE WHEN t.s_suppkey IS NOT NULL AND s.s_suppkey IS NOT NULL THEN t.s_acctbal + s.s_acctbal ELSE coalesce(t.s_acctbal, s.s_acctbal) END, 2) AS s_acctbal FROM supplier t FULL JOIN {_SOURCE} s ON t.s_suppkey = s.s_suppkey")
def on_conflict_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _changes(spark, sf_dir)
    return dml.upsert(t, s, ["s_suppkey"], {"s_acctbal": F.col("t.s_acctbal") + F.col("s.s_acctbal")}).withColumn("s_acctbal", F.round("s_acctbal", 2))


@query("SELECT c_custkey, CASE WHEN n_name IS NOT NULL THEN c_name || '/' || n_name ELSE c_name END AS c_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) n ON c_nationkey = n_nationkey")
def update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), "c_name")
    n = load(spark, sf_dir, "nation").filter("n_regionkey = 1").select("n_nationkey", "n_name")
    return dml.update_from(c, n, ["n_nationkey"], {"c_name": F.concat("t.c_name", F.lit("/"), "s.n_name")}).select("c_custkey", "c_name")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.update_where(load(spark, sf_dir, "orders"), F.col("o_orderstatus") == "O", {"o_orderpriority": F.lit("open")}).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return dml.delete_using(load(spark, sf_dir, "orders"), c, ["o_custkey"]).select("o_orderkey")


@query("SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.unique_violations(load(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.fk_violations(load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").filter("c_nationkey < 20"), {"o_custkey": "c_custkey"}).select("o_orderkey")


@query("SELECT n_nationkey, CASE WHEN n_regionkey <> 2 THEN n_regionkey END AS n_regionkey FROM nation")
def fk_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = load(spark, sf_dir, "region").filter("r_regionkey = 2")
    return dml.fk_cascade(load(spark, sf_dir, "nation"), gone, {"n_regionkey": "r_regionkey"}, "set null").select("n_nationkey", "n_regionkey")


@query("SELECT o_orderkey FROM (SELECT *, max(o_orderkey + 400) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM orders) WHERE o_orderkey < e")
def overlap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") + 400).alias("hi"))
    return dml.overlap_violations(o, ["o_custkey"], "o_orderkey", "hi").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_linenumber AS saved FROM lineitem")
def generated_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.generated(load(spark, sf_dir, "lineitem"), saved=F.col("l_quantity") * F.col("l_linenumber")).select("l_orderkey", "l_linenumber", "saved")


@query("SELECT CAST((CASE WHEN o_totalprice >= 50000 THEN 1 ELSE 0 END) + (CASE WHEN o_totalprice >= 150000 THEN 1 ELSE 0 END) AS INTEGER) AS part, count(*) AS n FROM orders GROUP BY 1")
def partition_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.partition_of(load(spark, sf_dir, "orders"), "o_totalprice", [50000.0, 150000.0]).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def partition_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in folders by value: the filter reads one of them."""
    path = folder(spark, "orders")
    load(spark, sf_dir, "orders").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).filter("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_orderstatus")


@query("SELECT 'l_returnflag' AS column_name, 0.0::DOUBLE AS null_frac, count(DISTINCT l_returnflag) AS n_distinct, min(l_returnflag) AS lo, max(l_returnflag) AS hi FROM lineitem UNION ALL SELECT 'l_linestatus', 0.0, count(DISTINCT l_linestatus), min(l_linestatus), max(l_linestatus) FROM lineitem")
def analyze_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.analyze(load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]).select("column_name", "null_frac", "n_distinct", "lo", "hi")


@query("SELECT p_partkey, round(p_retailprice * 1.2 + p_size, 2) AS v FROM part WHERE p_size <= 40")
def udf_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION gross_price(price DOUBLE, extra INT) RETURNS DOUBLE RETURN round(price * 1.2D + extra, 2)")
    return load(spark, sf_dir, "part").filter("p_size <= 40").selectExpr("p_partkey", "gross_price(p_retailprice, p_size) AS v")


@query("SELECT n_nationkey, CAST(g AS BIGINT) AS step, CAST(n_nationkey * g AS BIGINT) AS product FROM nation, generate_series(1, 3) AS t(g)")
def udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.functions import udtf as register

    @register(returnType="step bigint, product bigint")
    class Multiples:
        def eval(self, n: int, upto: int):
            for k in range(1, upto + 1):
                yield k, n * k

    spark.udtf.register("multiples_of", Multiples)
    return spark.sql("SELECT n_nationkey, step, product FROM {nation}, LATERAL multiples_of(n_nationkey, 3)", nation=load(spark, sf_dir, "nation"))


@query(f"SELECT CASE WHEN t.s_suppkey IS NULL THEN 'INSERT' WHEN s.s_suppkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op, count(*) AS n FROM supplier t FULL JOIN {_SOURCE} s ON t.s_suppkey = s.s_suppkey GROUP BY 1")
def cdc_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _changes(spark, sf_dir)
    return dml.diff(t, s, ["s_suppkey"]).groupBy("op").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of a streaming aggregation, over a stored table."""
    from sparrel.streaming.changes import tumbling

    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tumbling(e, "ts", "1 day", "1 hour", ["event_type"], n=F.count("*")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
