"""Functions by family that the other modules have no query for: digests, bytes and bits, numbers, patterns, names, times, JSON, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.functions import arrays, bits, datetime, json, numeric, text
from sparrel.operators import aggregate, catalog
from sparrel.plans.catalogue import query, same
from sparrel.session import load


def _rows(values: str, columns: str) -> str:
    return f"SELECT * FROM (VALUES {values}) AS v({columns})"


@query(_rows("('abc', 891568578, '23097d223405d8228642a477bda255b32aadbce4bda0b3f7e36c9da7', 'cb00753f45a35e8bb5a03d699ac65007272c32ab0eded1631a8b605a43ff5bed8086072ba1e7cc2358baeca134c825a7', 'ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f'), (NULL, NULL, NULL, NULL, NULL)", "s, c, d224, d384, d512"))
def digests_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return spark.createDataFrame([("abc",), (None,)], "s string").select("s", F.crc32(s.cast("binary")).alias("c"), F.sha2(s, 224).alias("d224"), F.sha2(s, 384).alias("d384"), F.sha2(s, 512).alias("d512"))


@query(_rows("('123456789', CAST(3808858755 AS BIGINT))", "s, c"))
def checksum_castagnoli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("123456789",)], "s string").select("s", text.crc32c(F.col("s")).alias("c"))


@query("SELECT n_nationkey, hex(encode(n_name)) AS h, to_base64(encode(n_name)) AS b, n_name AS back, ascii(substr(n_name, 2, 1)) AS second, 'X' || substr(n_name, 2) AS changed FROM nation")
def bytes_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("n_name").cast("binary")
    return load(spark, sf_dir, "nation").select(
        "n_nationkey", F.upper(text.encode(b, "hex")).alias("h"), text.encode(b, "base64").alias("b"), text.decode(text.encode(b, "hex"), "hex").cast("string").alias("back"),
        text.get_byte(b, 1).cast("int").alias("second"), text.set_byte(b, 0, 88).cast("string").alias("changed"),
    )


@query("SELECT n_nationkey, CAST((n_nationkey >> 4) & 1 AS INTEGER) AS first, CAST((n_nationkey >> 2) & 1 AS INTEGER) AS third, lpad(to_binary(n_nationkey | 16), 5, '0') AS changed FROM nation")
def bits_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = numeric.bit_string(F.col("n_nationkey"), 5)
    return load(spark, sf_dir, "nation").select("n_nationkey", bits.get_bit(b, 0).cast("int").alias("first"), bits.get_bit(b, 2).cast("int").alias("third"), bits.set_bit(b, 0, 1).alias("changed"))


@query(_rows("(CAST(1.25 AS DOUBLE), 2, 2, '1.25', '3ff4000000000000', '3fa00000'), (1.5, 2, 1, '1.5', '3ff8000000000000', '3fc00000'), (-7, 2, 0, '-7', 'c01c000000000000', 'c0e00000')", "x, scale, least, trimmed, wide, narrow"))
def scales_and_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("x").cast("decimal(10,2)")
    rows = spark.createDataFrame([(1.25,), (1.5,), (-7.0,)], "x double")
    return rows.select("x", numeric.scale(d).cast("int").alias("scale"), numeric.min_scale(d).cast("int").alias("least"), numeric.trim_scale(d).alias("trimmed"), numeric.float8send(F.col("x")).alias("wide"), numeric.float4send(F.col("x")).alias("narrow"))


@query(_rows("(0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE), (0.5, 0.47950012, 0.52049988), (-1, 1.84270079, -0.84270079)", "x, c, e"))
def error_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return spark.createDataFrame([(0.0,), (0.5,), (-1.0,)], "x double").select("x", F.round(numeric.erfc(x), 8).alias("c"), F.round(numeric.erf(x), 8).alias("e"))


same("powers_and_names", "SELECT p_partkey, pow(p_size, 2) AS p, ceiling(p_retailprice) AS c, character_length(p_name) AS n, conv(p_partkey, 10, 8) AS o FROM {part}", "SELECT p_partkey, pow(p_size, 2) AS p, CAST(ceiling(p_retailprice) AS BIGINT) AS c, CAST(length(p_name) AS INTEGER) AS n, printf('%o', p_partkey) AS o FROM part")
same("random_share", "SELECT count(*) AS n, count_if(r >= 0 AND r < 1) AS inside, count_if(r = again) AS again FROM (SELECT rand(7) AS r, random(7) AS again FROM {orders})", "SELECT count(*) AS n, count(*) AS inside, count(*) AS again FROM orders")
same("pattern_tests", "SELECT p_partkey, regexp_like(p_type, '^[A-M]') AS l, regexp_instr(p_name, '[0-9]') AS i, array_join(split(p_name, '[ a]'), '|') AS s FROM {part}", "SELECT p_partkey, regexp_matches(p_type, '^[A-M]') AS l, CAST(CASE WHEN regexp_matches(p_name, '[0-9]') THEN length(regexp_extract(p_name, '^[^0-9]*')) + 1 ELSE 0 END AS INTEGER) AS i, array_to_string(string_split_regex(p_name, '[ a]'), '|') AS s FROM part")


@query("SELECT p_partkey, regexp_extract(p_name, '([a-z]+) *([a-z]*)', 1) AS a, regexp_extract(p_name, '([a-z]+) *([a-z]*)', 2) AS b, regexp_matches(p_name, 'zz[0-9]') AS none FROM part")
def regexp_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = text.regexp_match(F.col("p_name"), "([a-z]+) *([a-z]*)")
    return load(spark, sf_dir, "part").select("p_partkey", m[0].alias("a"), m[1].alias("b"), text.regexp_match(F.col("p_name"), "zz[0-9]").isNotNull().alias("none"))


@query(_rows("('Ab.\"C d\"', 'ab|C d', '''Ab.\"C d\"''', 'é'), ('x', 'x', '''x''', 'é')", "s, parts, literal, composed"))
def names_and_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    rows = spark.createDataFrame([('Ab."C d"',), ("x",)], "s string")
    return rows.select("s", F.array_join(text.parse_ident(s), "|").alias("parts"), text.quote_literal(s).alias("literal"), text.normalize(text.unistr(F.lit("e\\0301")), "NFC").alias("composed"))


@query("SELECT o_orderkey, CAST(date_part('year', o_orderdate) AS INTEGER) AS y, CAST(date_part('week', o_orderdate) AS INTEGER) AS w, o_orderdate + INTERVAL 1 HOUR AS berlin FROM orders WHERE month(o_orderdate) IN (12, 1, 2)")
def date_part_and_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("o_orderdate")
    rows = load(spark, sf_dir, "orders").filter("month(o_orderdate) IN (12, 1, 2)")
    return rows.select("o_orderkey", F.date_part(F.lit("year"), t).alias("y"), F.date_part(F.lit("week"), t).alias("w"), datetime.at_time_zone(t, "Europe/Berlin").cast("timestamp_ntz").alias("berlin"))


same("clock", "SELECT current_date() = to_date(current_timestamp()) AS today, now() = current_timestamp() AS same, now() <= localtimestamp() + INTERVAL '1' DAY AS near FROM {region}", "SELECT true AS today, true AS same, true AS near FROM region")


@query("SELECT n_nationkey, CAST((n_nationkey * 40) // 30 AS INTEGER) AS months, CAST((n_nationkey * 40) % 30 + 1 AS INTEGER) AS days FROM nation WHERE n_nationkey > 0")
def justify_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    i = datetime.justify_interval(datetime.interval(0, k * 40, F.lit(86_400_000_000).cast("bigint")))
    return load(spark, sf_dir, "nation").filter("n_nationkey > 0").select("n_nationkey", i["months"].alias("months"), i["days"].alias("days"))


@query("SELECT p_partkey, CAST(len(a) AS INTEGER) AS n, 1 AS low, CAST(1 AS INTEGER) AS dims FROM (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part)")
def array_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.split("p_name", " ")
    return load(spark, sf_dir, "part").select("p_partkey", F.cardinality(a).alias("n"), arrays.array_lower(a).cast("int").alias("low"), F.lit(1).alias("dims"))


@query(_rows("('7', true, NULL, NULL), ('x', false, 'invalid input syntax for type integer: \"x\"', '22P02'), ('99999999999', false, 'value \"99999999999\" is out of range for type integer', '22003'), (NULL, NULL, NULL, NULL)", "s, ok, message, code"))
def input_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = F.col("s"), catalog.input_error(F.col("s"), "int")
    return spark.createDataFrame([("7",), ("x",), ("99999999999",), (None,)], "s string").select("s", catalog.input_is_valid(s, "int").alias("ok"), e["message"].alias("message"), e["sql_error_code"].alias("code"))


@query("SELECT 'bigint' AS a, 'text' AS b, 'double precision' AS c, 'timestamp without time zone' AS d, '20 kB' AS size, count(*) AS n FROM orders")
def types_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    names = [catalog.type_name(F.col(c)) for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")]
    return o.groupBy(*(x.alias(n) for x, n in zip(names, "abcd", strict=True)), catalog.size_pretty(F.lit(20_000)).alias("size")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_regionkey = 1 AS i, n_name LIKE 'N%0' AS t, (n_regionkey = 1) = (n_nationkey > 9) AS b FROM nation")
def operator_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    eq = catalog.apply_operator
    name = F.when(F.col("n_name").like("N%0"), F.col("n_name")).otherwise(F.lit(""))
    return load(spark, sf_dir, "nation").select("n_nationkey", eq("int4eq", F.col("n_regionkey"), F.lit(1)).alias("i"), eq("texteq", name, F.col("n_name")).alias("t"), eq("booleq", F.col("n_regionkey") == 1, F.col("n_nationkey") > 9).alias("b"))


same("session_names", "SELECT current_user() = session_user() AS same_user, length(current_user()) > 0 AS named, current_schema() AS place, version() RLIKE '^[0-9]+[.]' AS numbered, collation('x') LIKE '%UTF8_BINARY' AS bytewise, current_timezone() AS zone FROM {region}", "SELECT true AS same_user, true AS named, 'default' AS place, true AS numbered, true AS bytewise, 'UTC' AS zone FROM region")


# JSON constructors and aggregates
@query("SELECT n_nationkey, json_object('k', n_nationkey, 'r', nullif(n_regionkey, 2)) AS nulls, CASE WHEN n_regionkey = 2 THEN json_object('k', n_nationkey) ELSE json_object('k', n_nationkey, 'r', n_regionkey) END AS absent, json_array(n_nationkey, n_name, nullif(n_regionkey, 2)) AS a, CASE WHEN n_regionkey = 2 THEN json_array(n_name) ELSE json_array(n_name, n_regionkey) END AS b, to_json(n_name) AS s, to_json(n_nationkey) AS n FROM nation")
def json_constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r, name = F.col("n_nationkey"), F.nullif(F.col("n_regionkey"), F.lit(2)), F.col("n_name")
    pairs = [("k", k), ("r", r)]
    return load(spark, sf_dir, "nation").select(
        "n_nationkey", json.json_object(pairs).alias("nulls"), json.json_object(pairs, absent=True, unique=True).alias("absent"), json.json_array(k, name, r, absent=False).alias("a"), json.json_array(name, r).alias("b"), json.scalar(name).alias("s"), json.to_json(k).alias("n")
    )


@query("SELECT n_regionkey, to_json(list(n_name ORDER BY n_nationkey) FILTER (WHERE n_nationkey % 4 <> 0)) AS absent, to_json(list(CASE WHEN n_nationkey % 4 <> 0 THEN n_name END ORDER BY n_nationkey)) AS nulls FROM nation GROUP BY n_regionkey")
def json_arrayagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name"))
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(aggregate.json_arrayagg(x, F.col("n_nationkey")).alias("absent"), aggregate.json_arrayagg(x, F.col("n_nationkey"), absent=False).alias("nulls"))


_PAIRS = "(SELECT n_regionkey, 'k' || n_nationkey % 3 AS k, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey % 7 END AS v FROM nation)"


@query(f"""SELECT n_regionkey, '{{' || string_agg('"' || k || '":' || coalesce(CAST(v AS VARCHAR), 'null'), ',' ORDER BY k, coalesce(CAST(v AS VARCHAR), 'null')) || '}}' AS every, '{{' || string_agg('"' || k || '":' || v, ',' ORDER BY k, CAST(v AS VARCHAR)) FILTER (WHERE v IS NOT NULL) || '}}' AS absent,
(SELECT '{{' || string_agg('"' || k || '":' || m, ',' ORDER BY k) || '}}' FROM (SELECT k, max(coalesce(CAST(v AS VARCHAR), 'null')) AS m FROM {_PAIRS} q WHERE q.n_regionkey = p.n_regionkey GROUP BY k)) AS one FROM {_PAIRS} p GROUP BY n_regionkey""")
def json_objectagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal keys stay in json, one stays in jsonb."""
    k, v = F.concat(F.lit("k"), F.col("n_nationkey") % 3), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") % 7)
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(aggregate.json_object_agg(k, v).alias("every"), aggregate.json_object_agg(k, v, absent=True).alias("absent"), aggregate.jsonb_object_agg(k, v).alias("one"))


@query(_rows("""('{"a":1}', 'object'), ('[1]', 'array'), ('"x"', 'string'), ('-1.5', 'number'), ('true', 'boolean'), ('null', 'null'), (NULL, NULL)""", "j, kind"))
def json_typeof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([('{"a":1}',), ("[1]",), ('"x"',), ("-1.5",), ("true",), ("null",), (None,)], "j string")
    return rows.select("j", json.typeof(F.col("j")).alias("kind"))


@query("SELECT s_suppkey, json_object('s_suppkey', s_suppkey, 's_name', s_name, 'none', NULL) AS j FROM supplier")
def row_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").select("s_suppkey", json.row_to_json("s_suppkey", "s_name", F.lit(None).cast("string").alias("none")).alias("j"))


same("json_to_record", "SELECT event_id, r.k AS k, r.x AS x FROM (SELECT event_id, from_json(props, 'k STRING, x INT') AS r FROM {events}) AS t", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS INTEGER) AS x FROM events")


@query("SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS one, false AS none, true AS either FROM events")
def json_keys_any_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    return load(spark, sf_dir, "events").select("event_id", json.has_all(p, "k").alias("one"), json.has_all(p, "k", "z").alias("none"), json.has_any(p, "k", "z").alias("either"))
