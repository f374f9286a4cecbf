"""What the PostgreSQL dialect says shortly, as Spark SQL; DuckDB runs the dialect's own text."""

from __future__ import annotations

from sparrel.plans.catalogue import same

same("dialect_distinct_on", "SELECT o_custkey, min_by(o_orderkey, struct(-o_totalprice, o_orderkey)) AS o_orderkey FROM {orders} WHERE o_totalprice > 1000 GROUP BY o_custkey",
     "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
same("dialect_order_nulls", "SELECT x, CAST(row_number() OVER (ORDER BY x DESC NULLS FIRST) AS BIGINT) AS d FROM VALUES (1), (NULL), (3) AS v(x) ORDER BY x NULLS LAST LIMIT 2",
     "SELECT x, CAST(row_number() OVER (ORDER BY x DESC NULLS FIRST) AS BIGINT) AS d FROM (VALUES (1), (NULL), (3)) AS v(x) ORDER BY x NULLS LAST LIMIT 2")
same("dialect_regex", "SELECT p_partkey, p_name RLIKE '[0-9]5' AS a, NOT p_name RLIKE '^p' AS b, p_name RLIKE '(?i)P.*1' AS c FROM {part} WHERE p_type RLIKE '^[A-Z]'",
     "SELECT p_partkey, p_name ~ '[0-9]5' AS a, p_name !~ '^p' AS b, p_name ~* 'P.*1' AS c FROM part WHERE p_type ~ '^[A-Z]'")
same("dialect_casts", "SELECT CAST(o_orderkey AS STRING) AS t, CAST(o_totalprice > 100 AS INT) AS f, CAST('7' AS INT) + 1 AS n, CAST(o_orderdate AS DATE) AS d FROM {orders}",
     "SELECT o_orderkey::text AS t, (o_totalprice > 100)::int AS f, '7'::int4 + 1 AS n, o_orderdate::date AS d FROM orders")
same("dialect_any_array", "SELECT n_name FROM {nation} WHERE array_contains(array(1, 3), n_regionkey) AND n_nationkey IN (SELECT s_nationkey FROM {supplier})",
     "SELECT n_name FROM nation WHERE n_regionkey = ANY (ARRAY[1, 3]) AND n_nationkey = ANY (SELECT s_nationkey FROM supplier)")
same("dialect_string_agg", "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name DESC) AS names, count(*) FILTER (WHERE n_nationkey > 10) AS n FROM {nation} GROUP BY n_regionkey",
     "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names, count(*) FILTER (WHERE n_nationkey > 10) AS n FROM nation GROUP BY n_regionkey")
same("dialect_functions", "SELECT p_partkey, concat_ws('', p_brand, NULL, '-', p_type) AS c, regexp_replace(p_name, '^([^aeiou]*)[aeiou]', '$1_') AS one, regexp_replace(p_name, '[aeiou]', '_') AS every, array_join(array(p_brand, p_type), '/') AS j FROM {part}",
     "SELECT p_partkey, concat(p_brand, NULL, '-', p_type) AS c, regexp_replace(p_name, '[aeiou]', '_') AS one, regexp_replace(p_name, '[aeiou]', '_', 'g') AS every, array_to_string(ARRAY[p_brand, p_type], '/') AS j FROM part")
