"""Catalog objects, COPY, collations, time zones, type names, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.functions import arrays, datetime, numeric
from sparrel.operators import aggregate, catalog, dml, rows
from sparrel.plans.catalogue import query, same
from sparrel.session import load
from sparrel.sources import files
from sparrel.stored import folder

same("collation_compare", "SELECT p_partkey, p_type COLLATE UTF8_LCASE = 'promo' COLLATE UTF8_LCASE AS same_letters FROM {part}", "SELECT p_partkey, lower(p_type) = 'promo' AS same_letters FROM part")
same("distinct_nulls", "SELECT DISTINCT x, y FROM (VALUES (1, NULL), (1, NULL), (NULL, 2), (NULL, 2)) AS v(x, y)")
same("group_nan_zero", "SELECT count(*) AS n, count(DISTINCT k) AS d FROM (SELECT explode(array(CAST('NaN' AS DOUBLE), CAST('NaN' AS DOUBLE), 0.0D, -0.0D, 1.0D)) AS k) AS t", "SELECT 5::BIGINT AS n, 3::BIGINT AS d")
same("having_without_group", "SELECT count(*) AS n FROM {nation} HAVING count(*) > 3")
same("filter_then_distinct_count", "SELECT c_mktsegment, count(DISTINCT c_nationkey) FILTER (WHERE c_acctbal > 0) AS n FROM {customer} GROUP BY c_mktsegment")
same("cte_shadowing", "WITH nation AS (SELECT 1 AS k), t AS (SELECT k + 1 AS k FROM nation) SELECT k FROM t")
same("parameter_types", "SELECT CAST(smallint('7') AS INT) AS a, bigint(2147483648) AS b, CAST('1.25' AS DOUBLE) AS c, CAST('true' AS BOOLEAN) AS d, CAST('2024-02-29' AS DATE) AS e", "SELECT CAST(CAST('7' AS SMALLINT) AS INTEGER) AS a, CAST(2147483648 AS BIGINT) AS b, CAST('1.25' AS DOUBLE) AS c, CAST('true' AS BOOLEAN) AS d, CAST('2024-02-29' AS DATE) AS e")
same("pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}) PIVOT (count(l_linenumber) FOR l_linestatus IN ('O' AS o, 'F' AS f))", "SELECT l_returnflag, nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS f FROM lineitem GROUP BY l_returnflag")
same("percentile_array", "SELECT l_linestatus, percentile(l_quantity, 0.25) AS a, percentile(l_quantity, 0.75) AS b FROM {lineitem} GROUP BY l_linestatus", "SELECT l_linestatus, quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM lineitem GROUP BY l_linestatus")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey < 10 AND c_acctbal > 0")
def row_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = [catalog.Policy({"clerk"}, F.col("c_nationkey") < 5), catalog.Policy({"public"}, F.col("c_nationkey").between(5, 9)), catalog.Policy({"clerk"}, F.col("c_acctbal") > 0, permissive=False)]
    return catalog.visible(load(spark, sf_dir, "customer"), "clerk", policies).select("c_custkey", "c_nationkey")


@query("SELECT p_partkey, p_size AS positive FROM part")
def domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    positive = catalog.Domain("int", True, [lambda x: x > 0])
    return load(spark, sf_dir, "part").select("p_partkey", positive(F.col("p_size")).alias("positive"))


@query("SELECT o_orderkey, 100 + 10 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS id FROM orders")
def serial_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_serial(load(spark, sf_dir, "orders").select("o_orderkey"), "id", [F.col("o_orderkey")], 100, 10)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def copy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "copy")
    files.copy_to(load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, "text")
    return files.copy_from(spark, path, "s_suppkey bigint, s_name string, s_acctbal double", "text")


@query("SELECT n_nationkey, n_name, NULL AS extra FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def inheritance_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    return n.filter("n_regionkey = 0").select("n_nationkey", "n_name").unionByName(n.filter("n_regionkey = 1").select("n_nationkey", "n_name", F.col("n_regionkey").alias("extra")), allowMissingColumns=True)


@query("SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS TIMESTAMP) AS local_ts FROM events")
def at_time_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", datetime.at_time_zone(F.col("ts"), "America/New_York").alias("local_ts"))


@query("SELECT n_nationkey, DATE '2024-01-01' + n_nationkey AS d, TIMESTAMP '2024-01-01 00:00:00' + n_nationkey * INTERVAL 1 HOUR AS t FROM nation WHERE n_nationkey < 24")
def parse_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), k), "dd/MM/yyyy")
    clock = F.concat(F.lit("01-01-2024 "), F.lpad(k.cast("string"), 2, "0"), F.lit(":00"))
    return load(spark, sf_dir, "nation").filter("n_nationkey < 24").select("n_nationkey", datetime.to_date(day, "DD/MM/YYYY").alias("d"), datetime.to_timestamp(clock, "DD-MM-YYYY HH24:MI").alias("t"))


@query("SELECT p_partkey, 'integer' AS k, 'text' AS s, regexp_full_match(p_name, '[0-9]+') AS num FROM part")
def type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", catalog.type_name(F.col("p_size")).alias("k"), catalog.type_name(F.col("p_name")).alias("s"), catalog.input_is_valid(F.col("p_name"), "int").alias("num"))


@query("SELECT n_nationkey, array_to_string(string_split(n_name, 'N'), '|') AS parts, len(string_split(n_name, 'N')) AS k FROM nation")
def string_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = arrays.string_to_array(F.col("n_name"), "N")
    return load(spark, sf_dir, "nation").select("n_nationkey", arrays.array_to_string(a, "|").alias("parts"), arrays.array_upper(a).cast("bigint").alias("k"))


@query("SELECT c_nationkey, round(var_samp(c_custkey), 4) AS v FROM customer GROUP BY c_nationkey")
def variance_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(aggregate.variance_exact(F.col("c_custkey"), 4).cast("double").alias("v"))


@query("SELECT part, count(*) AS n FROM (SELECT CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'old' WHEN r_name = 'AMERICA' THEN 'new' ELSE 'default' END AS part FROM region) GROUP BY part")
def partition_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.list_partition_of(load(spark, sf_dir, "region"), "r_name", {"old": ["ASIA", "EUROPE"], "new": ["AMERICA"]}).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, 8 AS parts FROM orders")
def partition_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.hash_partition_of(load(spark, sf_dir, "orders"), ["o_custkey"], 8).agg(F.count("*").alias("n"), F.count_distinct("part").cast("int").alias("parts"))


@query("""SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparrel.streaming.changes import sessions

    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "ts", "1 hour", "1 hour", ["user_id"], n=F.count("*")).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 12) SELECT CAST(n AS BIGINT) AS n, CAST(n * n AS BIGINT) AS sq FROM t")
def recursive_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = spark.range(1, 2).select(F.col("id").alias("n"))
    return rows.recursive(seed, lambda new: new.filter("n < 12").select(F.col("n") + 1), distinct=False).select("n", (F.col("n") * F.col("n")).alias("sq"))


@query("SELECT p_partkey, CAST(0.842701 AS DOUBLE) AS e FROM part WHERE p_size = 10")
def math_erf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").filter("p_size = 10").select("p_partkey", F.round(numeric.erf(F.col("p_size").cast("double") / 10), 6).alias("e"))
