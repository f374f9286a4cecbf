"""Shapes of queries and edges of operators: set-returning functions, views, partitions, NaN keys, exact sums, ranges, text search, publications."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.functions import json, jsonpath, ranges, tsearch
from sparrel.operators import aggregate, catalog, dml, rows
from sparrel.plans.catalogue import query, same
from sparrel.session import load
from sparrel.sources import files
from sparrel.stored import folder


@query("SELECT count(*) AS n FROM nation")
def zero_column_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select().agg(F.count("*").alias("n"))


same("srf_in_group_by", "SELECT g, count(*) AS n FROM (SELECT explode(sequence(0, n_nationkey % 4)) AS g FROM {nation}) GROUP BY g", "SELECT g, count(*) AS n FROM (SELECT CAST(unnest(range(0, 1 + n_nationkey % 4)) AS INTEGER) AS g FROM nation) GROUP BY g")
same("common_type", "SELECT 1 AS x UNION ALL SELECT 2.5 UNION ALL SELECT NULL UNION ALL SELECT CAST(7 AS BIGINT)", "SELECT CAST(x AS DECIMAL(21,1)) AS x FROM (VALUES (1), (2.5), (NULL), (7)) AS v(x)")
same("named_windows", "SELECT p_partkey, sum(p_size) OVER a AS s, row_number() OVER b AS r, count(*) OVER a AS n FROM {part} WINDOW a AS (PARTITION BY p_brand), b AS (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey)", "SELECT p_partkey, CAST(sum(p_size) OVER a AS BIGINT) AS s, CAST(row_number() OVER b AS INTEGER) AS r, count(*) OVER a AS n FROM part WINDOW a AS (PARTITION BY p_brand), b AS (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey)")
same("array_subquery", "SELECT r_regionkey, (SELECT array_join(sort_array(collect_list(n_name)), ',') FROM {nation} WHERE n_regionkey = r_regionkey) AS names FROM {region}", "SELECT r_regionkey, array_to_string(ARRAY(SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name), ',') AS names FROM region")
same("composite_star", "SELECT n_nationkey, r.* FROM (SELECT n_nationkey, struct(n_name AS name, n_regionkey AS region) AS r FROM {nation}) AS t", "SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
same("order_using", "SELECT s_suppkey, s_acctbal FROM {supplier} ORDER BY s_acctbal DESC NULLS FIRST, s_suppkey LIMIT 7", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC NULLS FIRST, s_suppkey LIMIT 7")
same("join_nan_zero", "SELECT a.k AS x, b.k AS y FROM VALUES (1, CAST('NaN' AS DOUBLE)), (2, -0.0D), (3, CAST(NULL AS DOUBLE)), (4, 1.5D) AS a(k, v) JOIN VALUES (10, CAST('NaN' AS DOUBLE)), (20, 0.0D), (30, CAST(NULL AS DOUBLE)), (40, 1.5D), (50, -0.0D) AS b(k, v) ON a.v = b.v",
     "SELECT a.k AS x, b.k AS y FROM (VALUES (1, CAST('NaN' AS DOUBLE)), (2, -0.0::DOUBLE), (3, NULL), (4, 1.5)) AS a(k, v) JOIN (VALUES (10, CAST('NaN' AS DOUBLE)), (20, 0.0::DOUBLE), (30, NULL), (40, 1.5), (50, -0.0::DOUBLE)) AS b(k, v) ON a.v = b.v")
same("record_image_equal", "SELECT a.n_nationkey AS k, struct(a.n_name, nullif(a.n_regionkey, 1)) <=> struct(b.n_name, nullif(b.n_regionkey, 1)) AS image FROM {nation} a JOIN {nation} b ON b.n_nationkey = a.n_nationkey - a.n_nationkey % 2", "SELECT a.n_nationkey AS k, a.n_name = b.n_name AND nullif(a.n_regionkey, 1) IS NOT DISTINCT FROM nullif(b.n_regionkey, 1) AS image FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey - a.n_nationkey % 2")


@query("SELECT 'even' AS kind, CAST(30 AS BIGINT) AS total, 'division by zero' AS caught")
def sql_script_handler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A procedural body with a loop, IF, leaving early, and an error that a handler catches."""
    return spark.sql(
        """BEGIN
        DECLARE total BIGINT DEFAULT 0; DECLARE k INT DEFAULT 0; DECLARE caught STRING DEFAULT 'none';
        rounds: LOOP
          SET k = k + 1;
          IF k > 10 THEN LEAVE rounds; END IF;
          IF k % 2 = 1 THEN ITERATE rounds; END IF;
          SET total = total + k;
        END LOOP rounds;
        BEGIN
          DECLARE EXIT HANDLER FOR DIVIDE_BY_ZERO BEGIN SET caught = 'division by zero'; END;
          SELECT 1 / (k - 11);
        END;
        SELECT CASE WHEN total % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, total AS total, caught AS caught;
        END"""
    )


@query("SELECT n_nationkey, a, b, o FROM nation, (VALUES (1, 10, 1), (2, 11, 2), (3, NULL, 3)) AS v(a, b, o)")
def rows_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    zipped = rows.rows_from(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (10, 11))), ordinality=True)
    return load(spark, sf_dir, "nation").select("n_nationkey", F.inline(zipped)).toDF("n_nationkey", "a", "b", "o").withColumn("o", F.col("o").cast("int"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, unnest(string_split(p_brand, '#')) AS b FROM part")
def unnest_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.inline(rows.rows_from(F.split("p_name", " "), F.split("p_brand", "#")))).toDF("p_partkey", "w", "b")


@query("SELECT p_partkey, CAST(generate_subscripts(string_split(p_name, ' '), 1) AS BIGINT) AS k FROM part")
def generate_subscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.explode(rows.generate_series(F.lit(1), F.size(F.split("p_name", " ")))).alias("k"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())")
def group_by_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GROUP BY DISTINCT ROLLUP (a, b), ROLLUP (b, a)."""
    sets = aggregate.rollup_sets("l_returnflag", "l_linestatus") + aggregate.rollup_sets("l_linestatus", "l_returnflag")
    return aggregate.grouping_sets_distinct(load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"), sets, n=F.count("*"))


@query("SELECT l_returnflag, CAST(sum(CAST(l_orderkey AS HUGEINT) + 9223372036854000000) AS VARCHAR) AS s FROM lineitem GROUP BY 1")
def sum_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum of integers beyond 64 bits, each of which may be beyond them, too."""
    big = F.col("l_orderkey").cast("decimal(20,0)") + F.lit(9223372036854000000).cast("decimal(20,0)")
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(aggregate.sum_exact(big).cast("string").alias("s"))


@query("SELECT n_regionkey, lpad(to_binary(bit_and(n_nationkey | 16)), 5, '0') AS a, lpad(to_binary(bit_or(n_nationkey | 16)), 5, '0') AS o FROM nation GROUP BY 1")
def bit_string_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparrel.functions import numeric

    b = numeric.bit_string(F.col("n_nationkey").bitwiseOR(F.lit(16)), 5)
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(aggregate.bit_text_and(b).alias("a"), aggregate.bit_text_or(b).alias("o"))


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey >= 100")
def partitioned_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of two tables that are partitioned alike: the partition's number is part of the key, and a filter on it prunes both.

    Each task that reads a table writes what it has of each partition, so that a large partition is no one task's work.
    """
    bounds = [100, 2000, 6000]
    paths = {}
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        paths[name] = folder(spark, name)
        dml.partition_of(load(spark, sf_dir, name), key, bounds).write.partitionBy("part").parquet(paths[name])
    o, line = spark.read.parquet(paths["orders"]).filter("part >= 1"), spark.read.parquet(paths["lineitem"]).filter("part >= 1")
    return o.join(line, (o["part"] == line["part"]) & (o["o_orderkey"] == line["l_orderkey"])).select("o_orderkey", "l_linenumber")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def view_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog.create_view(load(spark, sf_dir, "customer").filter("c_acctbal > 0"), "paying_customers")
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM paying_customers GROUP BY 1")


@query("SELECT * FROM (VALUES ('region_copy', 'r_regionkey', 1, 'int'), ('region_copy', 'r_name', 2, 'string')) AS v(table_name, column_name, ordinal_position, data_type)")
def information_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog.create_view(load(spark, sf_dir, "region").select("r_regionkey", "r_name"), "region_copy")
    return catalog.information_columns(spark, "region_copy").drop("is_nullable")


@query("SELECT s_suppkey, s_name, s_acctbal, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN '' ELSE 'a,\"b\"' END AS note FROM supplier")
def copy_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, k = folder(spark, "copy"), F.col("s_suppkey")
    note = F.when(k % 3 == 1, F.lit("")).when(k % 3 == 2, F.lit('a,"b"'))
    files.copy_to(load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal", note.alias("note")), path, "csv", header=True)
    return files.copy_from(spark, path, "s_suppkey bigint, s_name string, s_acctbal double, note string", "csv", header=True)


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def create_table_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table in partitions, of which one is read."""
    name = f"orders_{uuid.uuid4().hex}"
    files.create_table_as(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), name, partition_by=["o_orderstatus"], path=folder(spark, name))
    return spark.table(name).filter("o_orderstatus = 'F'")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 0 UNION ALL SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0")
def inheritance_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent table and two children with columns of their own."""
    parent = load(spark, sf_dir, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name"))
    suppliers = load(spark, sf_dir, "supplier").select("s_acctbal", F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    customers = load(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("k"), "c_mktsegment")
    return files.inherit(parent, suppliers, customers)


@query("SELECT op, count(*) AS n, count(b) AS named FROM (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'DELETE' WHEN s_acctbal > 0 AND s_acctbal + 500 > 3000 AND NOT s_acctbal > 3000 THEN 'INSERT' ELSE 'UPDATE' END AS op, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS b FROM supplier WHERE (s_suppkey % 4 = 0 AND s_acctbal > 3000) OR (s_suppkey % 4 <> 0 AND s_acctbal + 500 > 3000)) GROUP BY 1")
def publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a table as a publication with a row filter and a column list sends them."""
    from sparrel.streaming.changes import publish

    old = load(spark, sf_dir, "supplier")
    new = old.filter("s_suppkey % 4 <> 0").withColumn("s_acctbal", F.col("s_acctbal") + 500)
    sent = publish(dml.diff(old, new, ["s_suppkey"]), F.col("r.s_acctbal") > 3000, ["s_suppkey", "s_name"])
    return sent.groupBy("op").agg(F.count("*").alias("n"), F.count("new.s_name").alias("named"))


# ranges
@query("""SELECT p_partkey, '[' || least(s, 12) || ',' || greatest(s + 5, 30) || ')' AS merged, CASE WHEN s >= 12 AND s + 5 <= 30 THEN 'empty' WHEN s < 12 AND s + 5 > 12 THEN '[' || s || ',12)' WHEN s < 30 AND s + 5 > 30 THEN '[30,' || s + 5 || ')' ELSE '[' || s || ',' || s + 5 || ')' END AS minus,
s >= 30 AS after, s + 5 <= 30 AS not_right, s >= 12 AS not_left, s AS lo, s + 5 AS hi FROM (SELECT p_partkey, p_size AS s FROM part)""")
def range_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    r, q = ranges.discrete(size, size + 5), ranges.discrete(F.lit(12), F.lit(30))
    return load(spark, sf_dir, "part").select(
        "p_partkey", ranges.to_text(ranges.merge(r, q)).alias("merged"), ranges.to_text(ranges.minus(r, q)).alias("minus"), ranges.after(r, q).alias("after"), ranges.not_right_of(r, q).alias("not_right"), ranges.not_left_of(r, q).alias("not_left"), r["lo"].alias("lo"), r["hi"].alias("hi")
    )


@query("SELECT * FROM (VALUES ('[1,5]', '[1,6)', false, true, 3), ('(1,5)', '[2,5)', false, true, 4), ('empty', 'empty', true, false, 1), ('(,7]', '(,8)', false, false, 2), ('[3,)', '[3,)', false, true, 5), ('(4,5)', 'empty', true, false, 1)) AS v(given, made, gone, lower_inc, place)")
def range_input_and_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranges.from_text(F.col("given"))
    given = spark.createDataFrame([(x,) for x in ("[1,5]", "(1,5)", "empty", "(,7]", "[3,)", "(4,5)")], "given string").withColumn("r", r)
    place = F.dense_rank().over(rows.Window.orderBy(ranges.sort_key(F.col("r"))))
    return given.select("given", ranges.to_text(F.col("r")).alias("made"), F.col("r.empty").alias("gone"), F.col("r.lo_inc").alias("lower_inc"), place.alias("place"))


@query("""SELECT n_nationkey, CASE WHEN k < 5 THEN '{[0,' || k || '),[' || k + 5 || ',10),[30,35)}' WHEN k < 10 THEN '{[0,' || k || '),[30,35)}' WHEN k > 25 THEN '{[0,10),[' || k + 5 || ',35)}' ELSE '{[0,10),[30,35)}' END AS minus,
CASE WHEN k < 5 OR (k >= 5 AND k < 10) THEN '{[' || k || ',' || least(k + 5, 10) || ')}' WHEN k > 25 THEN '{[30,' || k + 5 || ')}' ELSE '{}' END AS both, k < 10 OR k BETWEEN 30 AND 34 AS holds FROM (SELECT n_nationkey, n_nationkey + 1 AS k FROM nation)""")
def multirange_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") + 1
    fixed = F.array(ranges.discrete(F.lit(30), F.lit(35)), ranges.discrete(F.lit(0), F.lit(10)))
    one = F.array(ranges.discrete(k, k + 5))
    return load(spark, sf_dir, "nation").select("n_nationkey", ranges.multi_text(ranges.multi_minus(fixed, one)).alias("minus"), ranges.multi_text(ranges.multi_intersect(fixed, one)).alias("both"), ranges.multi_contains(fixed, k).alias("holds"))


# jsonpath and SQL/JSON
_DOC = '{"a": [1, 2.5, "x", null], "o": {"k": -3}}'


@query("SELECT * FROM (VALUES ('$.a.size()', '[4]'), ('$.a[0].type()', '[\"number\"]'), ('$.o.k.abs()', '[3]'), ('$.a[1].ceiling()', '[3]'), ('$.a[1].floor()', '[2]'), ('$.o.keyvalue().key', '[\"k\"]'), ('$.a[last]', '[null]'), ('$.a[0 to 1]', '[1,2.5]')) AS v(path, items)")
def jsonpath_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ("$.a.size()", "$.a[0].type()", "$.o.k.abs()", "$.a[1].ceiling()", "$.a[1].floor()", "$.o.keyvalue().key", "$.a[last]", "$.a[0 to 1]")
    doc = spark.createDataFrame([(_DOC,)], "j string")
    told = F.array(*(F.struct(F.lit(p).alias("path"), F.concat(F.lit("["), F.array_join(jsonpath.path_query(F.col("j"), p), ","), F.lit("]")).alias("items")) for p in paths))
    return doc.select(F.inline(told))


@query("SELECT event_id, '[' || k || ']' AS wrapped, CAST(k AS VARCHAR) AS bare, true AS there, false AS missing, -1 AS otherwise FROM (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events)")
def json_query_and_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    return load(spark, sf_dir, "events").select(
        "event_id", jsonpath.json_query(p, "$.k", wrapper=True).alias("wrapped"), jsonpath.json_query(p, "$.k").alias("bare"), jsonpath.path_exists(p, "$.k").alias("there"), jsonpath.path_exists(p, "$.z").alias("missing"),
        F.coalesce(jsonpath.json_value(p, "$.z", "int"), F.lit(-1)).alias("otherwise"),
    )


@query("SELECT event_id, k = 7 AS holds, k = 7 AS held, true AS every FROM (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events)")
def json_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    return load(spark, sf_dir, "events").select("event_id", json.contains(p, F.lit('{"k": 7}')).alias("holds"), json.contains(F.lit('{"k": 7, "z": [1]}'), p).alias("held"), json.contains(p, F.lit("{}")).alias("every"))


# text search
@query("SELECT * FROM (VALUES ('''cat'':3 ''fat'':2,6 ''mat'':7 ''sat'':4', '''cat'' ''fat'' ''mat'' ''sat''', '''cat'':3A ''fat'':2A,6A ''mat'':7A ''sat'':4A', '''fat'':2,6 ''mat'':7 ''sat'':4')) AS v(plain, stripped, weighted, without)")
def tsvector_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tsearch.to_tsvector(F.lit("The fat cats sat on fat mats"))
    text = tsearch.to_text
    return spark.range(1).select(text(v).alias("plain"), text(tsearch.strip(v)).alias("stripped"), text(tsearch.setweight(v, "A")).alias("weighted"), text(tsearch.delete(v, "cat")).alias("without"))


@query("""SELECT doc_id, list_contains(w, 'of') AND list_contains(w, 'the') AS plain, contains(t, ' of the ') AS phrase, contains(t, ' of the ') AND NOT list_contains(w, 'der') AS web
FROM (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM documents WHERE text IS NOT NULL))""")
def tsquery_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plainto, phraseto and websearch_to_tsquery."""
    t = F.col("text")
    made = {"plain": tsearch.plain_query("of the", "simple"), "phrase": tsearch.phrase_query("of the", "simple"), "web": tsearch.web_query('"of the" -der', "simple")}
    return load(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", *(tsearch.text_matches(t, q).alias(n) for n, q in made.items()))


@query("SELECT * FROM (VALUES ('paint & water', 0.05), ('breath & motion & water', 0.008333), ('ocean', 0.1), ('painted <-> Ship', 0.1)) AS v(q, density)")
def tsearch_rank_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts_rank_cd of four queries over a stanza."""
    stanza = "Day after day, day after day, We stuck, nor breath nor motion, As idle as a painted Ship Upon a painted Ocean. Water, water, every where And all the boards did shrink; Water, water, every where, Nor any drop to drink."
    v = tsearch.to_tsvector(F.lit(stanza))
    queries = ("paint & water", "breath & motion & water", "ocean", "painted <-> Ship")
    told = F.array(*(F.struct(F.lit(q).alias("q"), F.round(tsearch.ts_rank_cd(v, tsearch.parse_query(q)), 6).alias("density")) for q in queries))
    return spark.range(1).select(F.inline(told))
