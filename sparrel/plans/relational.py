"""Scans, predicates, joins, aggregation, sorting, set operations and CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.operators import aggregate, joins, rows
from sparrel.plans.catalogue import query, same
from sparrel.session import load

same("flagship", """SELECT c_mktsegment, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue, count(*) AS n
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY c_mktsegment ORDER BY revenue DESC, c_mktsegment LIMIT 10""".replace("TIMESTAMP", "TIMESTAMP_NTZ"),
"""SELECT c_mktsegment, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY c_mktsegment ORDER BY revenue DESC, c_mktsegment LIMIT 10""")

# scans, projection and predicates
same("scan_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity > 45 AND l_returnflag = 'R'")
same("project_expr", "SELECT o_orderkey, round(o_totalprice + 100, 2) AS gross, o_custkey % 7 AS bucket, -o_orderkey AS negated FROM {orders}")
same("empty_from", "SELECT 1 AS one, 'x' AS x, CAST(NULL AS INT) AS nothing")
same("table_statement", "TABLE {region}", "SELECT * FROM region")
same("derived_table", "SELECT k, n FROM (SELECT o_custkey, count(*) FROM {orders} GROUP BY o_custkey) AS s(k, n) WHERE n > 12")
same("column_alias_list", "SELECT a, b FROM {nation} AS t(a, b, c) WHERE c = 1")
same("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS third FROM {part}")
same("in_list", "SELECT n_name FROM {nation} WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 5, 9)")
same("like_ilike", "SELECT p_partkey, p_name LIKE '%1%' AS has_one, p_type ILIKE '%a%' AS has_a, p_brand NOT LIKE 'Brand#1_' AS other FROM {part}")
same("null_logic", "SELECT x IS NULL AS a, x IS NOT NULL AS b, (x > 1) IS TRUE AS c, (x > 1) IS NOT FALSE AS d, x > 1 OR y AS e, x > 1 AND y AS f, NOT y AS g FROM (VALUES (1, true), (2, false), (CAST(NULL AS INT), true), (CAST(NULL AS INT), CAST(NULL AS BOOLEAN))) AS v(x, y)")
same("is_distinct_from", "SELECT a, b, a IS DISTINCT FROM b AS d, a IS NOT DISTINCT FROM b AS s FROM (VALUES (1, 1), (1, 2), (CAST(NULL AS INT), 1), (CAST(NULL AS INT), CAST(NULL AS INT))) AS v(a, b)")
same("between", "SELECT o_orderkey FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 20000 AND o_orderkey NOT BETWEEN 100 AND 5000")
same("row_comparison", "SELECT s_suppkey FROM {supplier} WHERE (s_nationkey, s_suppkey) < (5, 50L)", "SELECT s_suppkey FROM supplier WHERE s_nationkey < 5 OR (s_nationkey = 5 AND s_suppkey < 50)")
same("quantified_array", "SELECT n_nationkey, exists(array(3, 7, 11), x -> n_nationkey > x) AS any_of, forall(array(3, 7, 11), x -> n_nationkey > x) AS all_of FROM {nation}",
     "SELECT n_nationkey, n_nationkey > ANY ([3, 7, 11]) AS any_of, n_nationkey > ALL ([3, 7, 11]) AS all_of FROM nation")
same("whole_row", "SELECT n_nationkey, to_json(struct(n_nationkey, n_name)) AS j FROM {nation}", "SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS j FROM nation")
same("tablesample_all", "SELECT count(*) AS n FROM {orders} TABLESAMPLE (100 PERCENT)", "SELECT count(*) AS n FROM orders")
same("values_join", "SELECT v.label, count(*) AS n FROM {nation} JOIN (VALUES (0, 'zero'), (1, 'one'), (2, 'two')) AS v(k, label) ON n_regionkey = v.k GROUP BY v.label")


@query("SELECT p_partkey, regexp_matches(p_type, '^(?:[A-Z]{3,8} .*|.*(?:BRASS|STEEL))$') AS hit FROM part")
def similar_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparrel.functions.text import similar_to as matches

    return load(spark, sf_dir, "part").select("p_partkey", matches(F.col("p_type"), "[A-Z]{3,8} %|%(BRASS|STEEL)").alias("hit"))


# joins
same("inner_join", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey AND c_acctbal > 5000")
same("left_join", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_totalprice > 200000")
same("right_join", "SELECT n_name, s_suppkey FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey AND s_acctbal > 0")
same("full_join_residual", "SELECT s_suppkey, c_custkey FROM {supplier} FULL JOIN {customer} ON s_suppkey = c_custkey AND s_acctbal < c_acctbal")
same("cross_join", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
same("self_join", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
same("theta_join", "SELECT a.r_regionkey AS x, b.r_regionkey AS y FROM {region} a JOIN {region} b ON a.r_regionkey > b.r_regionkey")
same("null_safe_join", "SELECT a.k AS ak, b.k AS bk FROM (VALUES (1), (CAST(NULL AS INT)), (3)) AS a(k) JOIN (VALUES (1), (CAST(NULL AS INT)), (4)) AS b(k) ON a.k IS NOT DISTINCT FROM b.k")
same("natural_join", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM {nation}) a NATURAL JOIN (SELECT c_nationkey AS k, c_custkey FROM {customer} WHERE c_acctbal > 9000) b")
same("semi_exists", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 250000)")
same("anti_not_exists", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 90000)")
same("in_subquery", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 2)")
same("not_in_null_aware", "SELECT n_nationkey FROM {nation} WHERE n_regionkey NOT IN (SELECT CASE WHEN r_regionkey > 3 THEN NULL ELSE r_regionkey END FROM {region})")
same("not_in_plain", "SELECT n_nationkey FROM {nation} WHERE n_regionkey NOT IN (SELECT r_regionkey FROM {region} WHERE r_regionkey < 3)")
same("scalar_subquery_corr", "SELECT c_custkey, (SELECT max(o_orderkey) FROM {orders} WHERE o_custkey = c_custkey) AS last_order FROM {customer}")
same("lateral_values", "SELECT n_nationkey, v.x FROM {nation}, LATERAL (SELECT n_nationkey * 10 + n_regionkey AS x) AS v")


@query("SELECT k, a, b FROM (SELECT s_nationkey AS k, count(*) AS a FROM supplier WHERE s_nationkey < 15 GROUP BY 1) FULL JOIN (SELECT c_nationkey AS k, count(*) AS b FROM customer WHERE c_nationkey > 8 GROUP BY 1) USING (k)")
def full_join_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").filter("s_nationkey < 15").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("a"))
    c = load(spark, sf_dir, "customer").filter("c_nationkey > 8").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("b"))
    return joins.full_using(s, c, ["k"])


@query("SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice BETWEEN p_retailprice * 100 AND p_retailprice * 100 + 300")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("lo"), (F.col("p_retailprice") * 100 + 300).alias("hi"))
    return joins.range_join(load(spark, sf_dir, "orders"), p, "o_totalprice", "lo", "hi", 300.0).select("o_orderkey", "p_partkey")


@query("SELECT a.p_partkey AS x, b.s_suppkey AS y FROM part a JOIN supplier b ON a.p_retailprice < b.s_acctbal + 5 AND b.s_acctbal < a.p_retailprice + 5")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("x"), F.col("p_retailprice").alias("al"), (F.col("p_retailprice") + 5).alias("ah"))
    b = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("y"), F.col("s_acctbal").alias("bl"), (F.col("s_acctbal") + 5).alias("bh"))
    return joins.overlap_join(a, b, "al", "ah", "bl", "bh", 50.0).select("x", "y")


@query("SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)")
def lateral_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    return joins.lateral_top(load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders"), {"c_custkey": "o_custkey"}, order, 1).select("c_custkey", "o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice > ALL (SELECT s_acctbal FROM supplier WHERE s_acctbal < 1000)")
def quantified_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.all_of(load(spark, sf_dir, "part"), "p_retailprice", load(spark, sf_dir, "supplier").filter("s_acctbal < 1000"), "s_acctbal", ">").select("p_partkey")


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal < ANY (SELECT p_retailprice FROM part)")
def quantified_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.any_of(load(spark, sf_dir, "supplier"), "s_acctbal", load(spark, sf_dir, "part"), "p_retailprice", "<").select("s_suppkey")


# aggregation
same("group_count_sum_avg", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
same("group_min_max", "SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS first_date, max(o_orderstatus) AS s FROM {orders} GROUP BY o_orderpriority")
same("global_agg_empty", "SELECT count(*) AS n, sum(o_orderkey) AS s, min(o_orderstatus) AS m FROM {orders} WHERE o_orderkey < 0", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, min(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0")
same("having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 15 AND max(o_totalprice) > 1000")
same("count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(l_orderkey) AS n FROM {lineitem} GROUP BY l_returnflag")
same("sum_distinct", "SELECT l_linestatus, sum(DISTINCT l_linenumber) AS s FROM {lineitem} GROUP BY l_linestatus", "SELECT l_linestatus, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_linestatus")
same("agg_filter", "SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 0) AS rich, round(sum(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING'), 2) AS s FROM {customer} GROUP BY c_nationkey")
same("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
same("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
same("cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY CUBE (c_mktsegment, c_nationkey)")
same("grouping_id", "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS g, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
same("stddev_variance", "SELECT l_returnflag, round(stddev_samp(l_quantity), 4) AS a, round(stddev_pop(l_quantity), 4) AS b, round(var_samp(l_quantity), 4) AS c, round(var_pop(l_quantity), 4) AS d, round(variance(l_tax), 8) AS e FROM {lineitem} GROUP BY l_returnflag")
same("bool_and_or", "SELECT o_orderpriority, bool_and(o_totalprice > 900) AS a, bool_or(o_totalprice > 300000) AS b, every(o_orderkey > 0) AS c FROM {orders} GROUP BY o_orderpriority", "SELECT o_orderpriority, bool_and(o_totalprice > 900) AS a, bool_or(o_totalprice > 300000) AS b, bool_and(o_orderkey > 0) AS c FROM orders GROUP BY o_orderpriority")
same("bit_agg", "SELECT c_nationkey, bit_and(c_custkey) AS a, bit_or(c_custkey) AS o, bit_xor(c_custkey) AS x FROM {customer} GROUP BY c_nationkey")
same("percentile_cont", "SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS med, percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity DESC) AS low FROM {lineitem} GROUP BY l_returnflag")
same("percentile_disc", "SELECT o_orderstatus, percentile_disc(0.25) WITHIN GROUP (ORDER BY o_totalprice) AS q1 FROM {orders} GROUP BY o_orderstatus")
same("group_by_expression", "SELECT year(o_orderdate) AS y, o_custkey % 3 AS m, count(*) AS n FROM {orders} GROUP BY 1, 2", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_custkey % 3 AS m, count(*) AS n FROM orders GROUP BY 1, 2")


@query("SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY c_custkey) AS s FROM customer GROUP BY c_nationkey")
def string_agg_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(aggregate.string_agg(F.col("c_mktsegment"), ",", F.col("c_custkey")).alias("s"))


@query("SELECT n_regionkey, array_to_string(list_transform(array_agg(CASE WHEN n_nationkey % 4 <> 0 THEN n_name END ORDER BY n_nationkey), lambda x: coalesce(x, 'NULL')), ',') AS a FROM nation GROUP BY n_regionkey")
def array_agg_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name"))
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(aggregate.array_agg(x, F.col("n_nationkey")), ",", "NULL").alias("a"))


@query("SELECT n_regionkey, '[' || string_agg(coalesce('\"' || CASE WHEN n_nationkey % 4 <> 0 THEN n_name END || '\"', 'null'), ',' ORDER BY n_nationkey) || ']' AS j FROM nation GROUP BY n_regionkey")
def json_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name"))
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(aggregate.json_agg(x, F.col("n_nationkey")).alias("j"))


@query("SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS j FROM nation GROUP BY n_regionkey")
def json_object_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(aggregate.json_object_agg(F.col("n_name"), F.col("n_nationkey")).alias("j"))


@query("SELECT l_returnflag, (array_agg(l_linenumber ORDER BY n DESC, l_linenumber))[1] AS m FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(aggregate.mode(F.col("l_linenumber")).alias("m"))


@query("""SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice < 100000) + 1 AS r, count(DISTINCT o_totalprice) FILTER (WHERE o_totalprice < 100000) + 1 AS d,
round(count(*) FILTER (WHERE o_totalprice < 100000) / count(*), 8) AS p, round((count(*) FILTER (WHERE o_totalprice <= 100000) + 1) / (count(*) + 1), 8) AS c FROM orders GROUP BY o_orderstatus""")
def hypothetical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lambda kind: aggregate.hypothetical(kind, 100000.0, F.col("o_totalprice"))
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(h("rank").alias("r"), h("dense_rank").alias("d"), F.round(h("percent_rank"), 8).alias("p"), F.round(h("cume_dist"), 8).alias("c"))


@query("SELECT c_mktsegment, CAST(max(abs(c_nationkey)) + count(*) AS DOUBLE) AS v FROM customer GROUP BY c_mktsegment")
def user_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    widest = aggregate.user_aggregate(lambda state, x: (max(state[0], abs(int(x))), state[1] + 1), (0, 0), lambda s: float(s[0] + s[1]))
    return load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(widest("c_nationkey").alias("v"))


@query("SELECT s_nationkey, CAST(sum(s_suppkey) * 2 AS BIGINT) AS v FROM supplier GROUP BY s_nationkey")
def user_agg_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(aggregate.fold(F.col("s_suppkey"), F.lit(0).cast("bigint"), lambda s, x: s + x * 2).alias("v"))


@query("""WITH r AS (SELECT o_custkey AS k, o_orderkey AS lo, o_orderkey + 900 AS hi FROM orders),
m AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM r),
g AS (SELECT *, sum(CASE WHEN e IS NULL OR lo > e THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT k, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY k, i""")
def range_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + 900).alias("hi"))
    return aggregate.range_agg(r, ["k"], "lo", "hi")


@query("SELECT n_regionkey, max(n_nationkey) AS lo, min(n_nationkey + 10) AS hi FROM nation GROUP BY n_regionkey")
def range_intersect_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = aggregate.range_intersect_agg(F.col("n_nationkey"), F.col("n_nationkey") + 10)
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(lo.alias("lo"), hi.alias("hi"))


# sorting, limits, DISTINCT ON, set operations
same("top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS LAST LIMIT 20")
same("offset_limit", "SELECT c_custkey FROM {customer} ORDER BY c_custkey LIMIT 10 OFFSET 25")
same("order_nulls", "SELECT k, x FROM (SELECT x, row_number() OVER (ORDER BY x DESC NULLS FIRST) AS k FROM (VALUES (3), (CAST(NULL AS INT)), (1)) AS v(x)) AS t", "SELECT CAST(k AS INTEGER) AS k, x FROM (SELECT x, row_number() OVER (ORDER BY x DESC NULLS FIRST) AS k FROM (VALUES (3), (CAST(NULL AS INT)), (1)) AS v(x)) AS t")
same("distinct", "SELECT DISTINCT l_shipmode_like, l_linestatus FROM (SELECT l_linenumber % 3 AS l_shipmode_like, l_linestatus FROM {lineitem}) AS t")
same("union", "SELECT n_regionkey AS k FROM {nation} UNION SELECT r_regionkey + 3 FROM {region}")
same("union_all", "SELECT n_regionkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}")
same("intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
same("intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
same("except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_suppkey < 60")
same("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
same("set_precedence", "SELECT r_regionkey AS k FROM {region} UNION SELECT n_nationkey FROM {nation} INTERSECT SELECT s_nationkey FROM {supplier} WHERE s_suppkey < 30")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.distinct_on(load(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


# CTEs and recursion
same("cte_chain", "WITH a(k, n) AS (SELECT o_custkey, count(*) FROM {orders} GROUP BY o_custkey), b AS (SELECT n, count(*) AS m FROM a GROUP BY n) SELECT n, m FROM b WHERE m > 3")
same("recursive_series", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation WHERE n_nationkey < 5),
t AS (SELECT a, b FROM e WHERE a < 4 UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t""")
def recursive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    e = n.select(key.alias("a"), ((key * 7 + 3) % 25).alias("b")).unionAll(n.filter("n_nationkey < 5").select(key, (key * 3 + 1) % 25))
    return rows.recursive(e.filter("a < 4"), lambda new: new.alias("t").join(e.alias("e"), F.col("t.b") == F.col("e.a")).select(F.col("t.a"), F.col("e.b")))
