"""Set-returning functions, JSON, ranges, text search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.functions import json, json_table, jsonpath, ranges, tsearch
from sparrel.operators import rows
from sparrel.plans.catalogue import query, same
from sparrel.session import load

same("generate_series", "SELECT n_nationkey, g FROM {nation} LATERAL VIEW explode(sequence(n_nationkey, 24, 5)) AS g", "SELECT n_nationkey, CAST(g AS INTEGER) AS g FROM nation, generate_series(n_nationkey, 24, 5) AS t(g)")
same("regexp_split", "SELECT p_partkey, w FROM {part} LATERAL VIEW explode(split(p_name, '[ ]+')) AS w", "SELECT p_partkey, unnest(string_split_regex(p_name, '[ ]+')) AS w FROM part")
same("regexp_matches_all", "SELECT p_partkey, w FROM {part} LATERAL VIEW explode(regexp_extract_all(p_name, '([a-z]+)[0-9]*', 1)) AS w", "SELECT p_partkey, unnest(regexp_extract_all(p_name, '([a-z]+)[0-9]*', 1)) AS w FROM part")
same("json_extract", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
same("json_each", "SELECT event_id, k, v FROM {events} LATERAL VIEW explode(from_json(props, 'map<string,string>')) AS k, v", "SELECT event_id, unnest(json_keys(props)) AS k, json_extract_string(props, '$.k') AS v FROM events")
same("json_object_keys", "SELECT event_id, k FROM {events} LATERAL VIEW explode(json_object_keys(props)) AS k", "SELECT event_id, unnest(json_keys(props)) AS k FROM events")
same("json_array_elements", "SELECT n_nationkey, CAST(e AS INT) AS e FROM {nation} LATERAL VIEW explode(from_json(concat('[', n_nationkey, ',', n_regionkey, ']'), 'array<string>')) AS e", "SELECT n_nationkey, unnest([n_nationkey, n_regionkey]) AS e FROM nation")
same("json_to_recordset", "SELECT n_nationkey, a, b FROM {nation} LATERAL VIEW inline(from_json(to_json(array(named_struct('a', n_nationkey, 'b', 'x'), named_struct('a', n_regionkey, 'b', CAST(NULL AS STRING)))), 'array<struct<a:int,b:string>>')) AS a, b", "SELECT n_nationkey, n_nationkey AS a, 'x' AS b FROM nation UNION ALL SELECT n_nationkey, n_regionkey, NULL FROM nation")


@query("SELECT p_partkey, w, CAST(o AS BIGINT) AS o FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS o FROM part)")
def unnest_ordinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.with_ordinality(load(spark, sf_dir, "part"), ["p_partkey"], F.split("p_name", " "), "w", "o")


@query("SELECT n_nationkey, unnest(range(1, 1 + n_nationkey % 4)) AS a, unnest(range(10, 12)) AS b FROM nation")
def project_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    return rows.project_set(load(spark, sf_dir, "nation"), ["n_nationkey"], a=rows.generate_series(F.lit(1), k % 4), b=rows.generate_series(10, 11))


# JSON
@query("SELECT event_id, CAST(props AS JSON) ->> '$.k' = '1' AS one, json_exists(props, '$.k') AS has, json_type(props) = 'OBJECT' AS obj FROM events")
def json_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    return load(spark, sf_dir, "events").select("event_id", (json.field_text(p, "k") == "1").alias("one"), json.has_key(p, "k").alias("has"), (json.typeof(p) == "object").alias("obj"))


@query("SELECT event_id, json_extract(props, '$.k')::INT = 7 AS holds FROM events")
def json_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", json.contains(F.col("props"), F.lit('{"k": 7.0}')).alias("holds"))


@query("SELECT event_id, json_extract(props, '$.k')::INT AS v FROM events WHERE json_extract(props, '$.k')::INT > 50")
def jsonpath_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", F.explode(jsonpath.path_values(F.col("props"), "$.k ? (@ > 50)", "int")).alias("v"))
    return e


@query("SELECT event_id, json_extract(props, '$.k')::INT % 2 = 0 AS even, json_extract(props, '$.k')::INT >= 10 AS ten FROM events")
def jsonpath_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    return load(spark, sf_dir, "events").select("event_id", jsonpath.path_match(p, "$.k % 2 == 0").alias("even"), jsonpath.path_exists(p, "$ ? (@.k >= 10)").alias("ten"))


@query("SELECT event_id, json_extract(props, '$.k')::INT AS v, props IS NOT NULL AS ok FROM events")
def json_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", jsonpath.json_value(F.col("props"), "$.k", "int").alias("v"), json.is_json(F.col("props")).alias("ok"))


@query("SELECT n_nationkey, CAST(o AS INTEGER) AS o, CAST(CASE o WHEN 1 THEN n_nationkey ELSE n_regionkey END AS INTEGER) AS a, o = 1 AS has_b, CASE WHEN o = 1 THEN x END AS x FROM nation, (VALUES (1, 'p'), (1, 'q'), (2, NULL)) AS v(o, x)")
def json_table_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.concat(F.lit('[{"a":'), "n_nationkey", F.lit(',"b":["p","q"]},{"a":'), "n_regionkey", F.lit("}]"))
    columns = [json_table.Ordinality("o"), json_table.Value("a", "int"), json_table.Exists("has_b", "$.b"), json_table.Nested("$.b[*]", [json_table.Value("x", path="$")])]
    return json_table.json_table(load(spark, sf_dir, "nation").select("n_nationkey", j.alias("j")), "j", "$[*]", columns).drop("j")


# ranges
@query("SELECT p_partkey, p_size BETWEEN 10 AND 20 AS c, p_size < 30 AND p_size + 5 > 12 AS o, p_size = 30 OR p_size + 5 = 12 AS adj, p_size + 5 <= 12 AS b, '[' || greatest(p_size, 12) || ',' || least(p_size + 5, 30) || ')' AS i FROM part WHERE p_size < 30 AND p_size + 5 > 12 UNION ALL SELECT p_partkey, p_size BETWEEN 10 AND 20, false, p_size = 30 OR p_size + 5 = 12, p_size + 5 <= 12, 'empty' FROM part WHERE NOT (p_size < 30 AND p_size + 5 > 12)")
def range_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    r, q = ranges.discrete(size, size + 5), ranges.discrete(F.lit(12), F.lit(30))
    return load(spark, sf_dir, "part").select("p_partkey", ranges.contains(ranges.discrete(F.lit(10), F.lit(20), "[]"), size).alias("c"), ranges.overlaps(r, q).alias("o"), ranges.adjacent(r, q).alias("adj"), ranges.before(r, q).alias("b"), ranges.to_text(ranges.intersect(r, q)).alias("i"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey <= 10 THEN '{[0,' || greatest(10, n_nationkey + 5) || '),[30,35)}' WHEN n_nationkey < 25 AND n_nationkey + 5 >= 30 THEN '{[0,10),[' || n_nationkey || ',35)}' ELSE '{[0,10),[' || n_nationkey || ',' || n_nationkey + 5 || '),[30,35)}' END AS m FROM nation")
def multirange_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    fixed = F.array(ranges.discrete(F.lit(30), F.lit(35)), ranges.discrete(F.lit(0), F.lit(10)))
    got = ranges.multi_union(fixed, F.array(ranges.discrete(k, k + 5)))
    return load(spark, sf_dir, "nation").select("n_nationkey", ranges.multi_text(got).alias("m"))


# text search
def _search(spark: SparkSession, sf_dir: str, config: str = "simple") -> DataFrame:
    docs = load(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", tsearch.to_tsvector(F.col("text"), config).alias("v"))


@query("SELECT doc_id, list_contains(w, 'the') AND NOT list_contains(w, 'der') AS a, list_contains(w, 'trash') OR list_contains(w, 'idiot') AS b FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM documents WHERE text IS NOT NULL)")
def tsearch_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, query = F.col("text"), tsearch.parse_query
    docs = load(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", tsearch.text_matches(t, query("the & !der", "simple")).alias("a"), tsearch.text_matches(t, query("trash | idiot", "simple")).alias("b"))


@query("SELECT doc_id, contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\\pL\\pN]+'), ' ') || ' ', ' of the ') AS p FROM documents WHERE text IS NOT NULL")
def tsearch_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", tsearch.text_matches(F.col("text"), tsearch.parse_query("of <-> the", "simple")).alias("p"))


@query("SELECT doc_id, list_contains(w, 'the') AND NOT list_contains(w, 'der') AS a, contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') AS p, len(list_distinct(w)) AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM documents WHERE text IS NOT NULL AND length(text) < 2000)")
def tsearch_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries over tsvectors, of texts whose words all have a place of their own there."""
    docs = load(spark, sf_dir, "documents").filter("text IS NOT NULL AND length(text) < 2000")
    v, query = F.col("v"), tsearch.parse_query
    found = docs.select("doc_id", tsearch.to_tsvector(F.col("text"), "simple").alias("v"))
    return found.select("doc_id", tsearch.matches(v, query("the & !der", "simple")).alias("a"), tsearch.matches(v, query("of <-> the", "simple")).alias("p"), F.size("v").cast("bigint").alias("n"))


@query()
def tsearch_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = tsearch.parse_query("thing & that")
    return _search(spark, sf_dir, "english").filter(tsearch.matches(F.col("v"), q)).select("doc_id", F.round(tsearch.ts_rank(F.col("v"), q), 6).alias("rank"))
