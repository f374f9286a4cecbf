"""Scalar functions by family: SQL where Spark agrees, functions of this package where it does not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.functions import arrays, bits, datetime, format, numeric, text
from sparrel.plans.catalogue import query, same
from sparrel.session import load

same("math_basic", "SELECT o_orderkey, abs(-o_totalprice) AS a, ceil(o_totalprice) AS c, floor(o_totalprice) AS f, sign(o_totalprice - 100000) AS s, mod(o_orderkey, 7) AS m, o_orderkey DIV 7 AS d FROM {orders}",
     "SELECT o_orderkey, abs(-o_totalprice) AS a, CAST(ceil(o_totalprice) AS BIGINT) AS c, CAST(floor(o_totalprice) AS BIGINT) AS f, CAST(sign(o_totalprice - 100000) AS DOUBLE) AS s, mod(o_orderkey, 7) AS m, o_orderkey // 7 AS d FROM orders")
same("math_roots_logs", "SELECT p_partkey, round(sqrt(p_size), 8) AS s, round(cbrt(p_size), 8) AS c, round(ln(p_size), 8) AS l, round(log10(p_size), 8) AS t, round(log(2, p_size), 8) AS b, round(exp(p_size / 10.0D), 6) AS e, round(power(p_size, 2.5D), 4) AS p FROM {part}",
     "SELECT p_partkey, round(sqrt(p_size), 8) AS s, round(cbrt(p_size), 8) AS c, round(ln(p_size), 8) AS l, round(log10(p_size), 8) AS t, round(log(2, p_size), 8) AS b, round(exp(p_size / 10.0), 6) AS e, round(power(p_size, 2.5), 4) AS p FROM part")
same("math_trig", "SELECT p_partkey, round(sin(p_size), 8) AS a, round(cos(p_size), 8) AS b, round(tan(p_size), 6) AS c, round(atan(p_size), 8) AS d, round(atan2(p_size, 3.0D), 8) AS e, round(asin(p_size / 100.0D), 8) AS f, round(acos(p_size / 100.0D), 8) AS g, round(sinh(p_size / 20.0D), 6) AS h, round(tanh(p_size / 20.0D), 8) AS i, round(cosh(p_size / 20.0D), 6) AS j, round(degrees(p_size), 6) AS k, round(radians(p_size), 8) AS l, round(pi(), 10) AS m FROM {part}",
     "SELECT p_partkey, round(sin(p_size), 8) AS a, round(cos(p_size), 8) AS b, round(tan(p_size), 6) AS c, round(atan(p_size), 8) AS d, round(atan2(p_size, 3.0), 8) AS e, round(asin(p_size / 100.0), 8) AS f, round(acos(p_size / 100.0), 8) AS g, round(sinh(p_size / 20.0), 6) AS h, round(tanh(p_size / 20.0), 8) AS i, round(cosh(p_size / 20.0), 6) AS j, round(degrees(p_size), 6) AS k, round(radians(p_size), 8) AS l, round(pi(), 10) AS m FROM part")
same("width_bucket", "SELECT o_orderkey, width_bucket(o_totalprice, 0, 400000, 8) AS b FROM {orders}", "SELECT o_orderkey, CAST(CASE WHEN o_totalprice >= 400000 THEN 9 WHEN o_totalprice < 0 THEN 0 ELSE floor(o_totalprice / 50000) + 1 END AS BIGINT) AS b FROM orders")
same("conditional", "SELECT s_suppkey, coalesce(nullif(s_nationkey, 3), -1) AS a, greatest(s_nationkey, 7, NULL) AS g, least(s_nationkey, 7, NULL) AS l FROM {supplier}")
same("text_basic", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n, reverse(p_type) AS r, replace(p_type, 'A', '_') AS x, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, repeat('ab', 3) AS rep, translate(p_type, 'ABC', 'xy') AS t, position('a' IN p_name) AS p, split_part(p_name, ' ', 2) AS sp, ascii(p_name) AS a FROM {part}",
     "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS INTEGER) AS n, reverse(p_type) AS r, replace(p_type, 'A', '_') AS x, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, repeat('ab', 3) AS rep, replace(translate(p_type, 'AB', 'xy'), 'C', '') AS t, CAST(position('a' IN p_name) AS INTEGER) AS p, split_part(p_name, ' ', 2) AS sp, ascii(p_name) AS a FROM part")
same("text_trim", "SELECT trim(s) AS a, ltrim(s) AS b, rtrim(s) AS c, trim(BOTH 'x' FROM t) AS d, trim(LEADING 'x' FROM t) AS e, trim(TRAILING 'x' FROM t) AS f, concat_ws('-', s, NULL, t) AS g, s || t AS h FROM (VALUES ('  a b ', 'xxhixx'), ('', 'x')) AS v(s, t)",
     "SELECT trim(s) AS a, ltrim(s) AS b, rtrim(s) AS c, trim(t, 'x') AS d, ltrim(t, 'x') AS e, rtrim(t, 'x') AS f, concat_ws('-', s, NULL, t) AS g, s || t AS h FROM (VALUES ('  a b ', 'xxhixx'), ('', 'x')) AS v(s, t)")
same("digests", "SELECT n_nationkey, md5(n_name) AS m, sha2(n_name, 256) AS s FROM {nation}", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s FROM nation")
same("regexp_basic", "SELECT p_partkey, p_type RLIKE '^[A-M]' AS r, regexp_count(p_name, '[aeiou]') AS c, regexp_substr(p_name, '[0-9]+') AS d FROM {part}",
     "SELECT p_partkey, regexp_matches(p_type, '^[A-M]') AS r, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS INTEGER) AS c, nullif(regexp_extract(p_name, '[0-9]+'), '') AS d FROM part")
same("date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofyear(o_orderdate) AS j, weekofyear(o_orderdate) AS w, extract(DOW FROM o_orderdate) - 1 AS dow FROM {orders}",
     "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(dayofyear(o_orderdate) AS INTEGER) AS j, CAST(weekofyear(o_orderdate) AS INTEGER) AS w, CAST(dayofweek(o_orderdate) AS INTEGER) AS dow FROM orders")
same("date_trunc", "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS h, CAST(date_trunc('month', ts) AS TIMESTAMP_NTZ) AS m, CAST(date_trunc('week', ts) AS DATE) AS w FROM {events}", "SELECT event_id, date_trunc('hour', ts) AS h, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, CAST(date_trunc('week', ts) AS DATE) AS w FROM events")
same("make_temporal", "SELECT n_nationkey, make_date(2020, 1 + n_nationkey % 12, 1 + n_nationkey) AS d, make_timestamp_ntz(2020, 1 + n_nationkey % 12, 3, 4, 5, 6.5) AS t FROM {nation}", "SELECT n_nationkey, make_date(2020, 1 + n_nationkey % 12, 1 + n_nationkey) AS d, make_timestamp(2020, 1 + n_nationkey % 12, 3, 4, 5, 6.5) AS t FROM nation")
same("interval_add", "SELECT o_orderkey, o_orderdate + INTERVAL '10' DAY AS a, o_orderdate + INTERVAL '1' MONTH AS b, o_orderdate - INTERVAL '3' HOUR AS c FROM {orders}", "SELECT o_orderkey, o_orderdate + INTERVAL '10' DAY AS a, o_orderdate + INTERVAL '1' MONTH AS b, o_orderdate - INTERVAL '3' HOUR AS c FROM orders")
same("bitwise", "SELECT c_custkey, c_custkey & 12 AS a, c_custkey | 3 AS o, c_custkey ^ 5 AS x, ~c_custkey AS n, shiftleft(c_custkey, 2) AS l, shiftright(c_custkey, 1) AS r, bit_count(c_custkey) AS c FROM {customer}",
     "SELECT c_custkey, c_custkey & 12 AS a, c_custkey | 3 AS o, xor(c_custkey, 5) AS x, ~c_custkey AS n, c_custkey << 2 AS l, c_custkey >> 1 AS r, CAST(bit_count(c_custkey) AS INTEGER) AS c FROM customer")


@query("SELECT p_partkey, trunc(p_retailprice * 10) / 10 AS t, CAST(gcd(p_partkey, p_size * 6) AS BIGINT) AS g, CAST(lcm(p_partkey, p_size) AS BIGINT) AS l, CAST(round_even(p_size / 2, 0) AS DOUBLE) AS e, p_partkey // 7 AS d, CAST(CASE WHEN p_size >= 40 THEN 3 WHEN p_size >= 20 THEN 2 WHEN p_size >= 10 THEN 1 ELSE 0 END AS INTEGER) AS w, CAST(factorial(p_size % 15) AS VARCHAR) AS f FROM part")
def math_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return load(spark, sf_dir, "part").select(
        "p_partkey", numeric.trunc(F.col("p_retailprice"), 1).alias("t"), numeric.gcd(key, size * 6).alias("g"), numeric.lcm(key, size).alias("l"), numeric.round_even(size / 2).alias("e"),
        numeric.int_div(key, F.lit(7)).alias("d"), numeric.width_bucket_of(size, F.array(F.lit(10), F.lit(20), F.lit(40))).alias("w"), numeric.factorial(size % 15).cast("string").alias("f"),
    )


@query("SELECT p_partkey, round(gamma(p_size + 1), -40) * 0 + round(lgamma(p_size + 1), 6) AS g FROM part")
def math_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.round(numeric.lgamma(F.col("p_size").cast("double") + 1), 6).alias("g"))


@query("SELECT p_partkey, p_brand || coalesce(nullif(p_type, 'PROMO'), '') AS c, CASE WHEN length(p_name) > 3 THEN left(p_name, length(p_name) - 3) ELSE '' END AS l, right(p_name, 4) AS r, substring(p_name, 1, 2) AS s, chr(960 + p_size) AS k, lower(to_hex(p_partkey)) AS h, to_binary(p_partkey) AS b, CAST(instr(p_name, '1') AS INTEGER) AS i, regexp_replace(p_name, '[0-9]', '#') AS one, regexp_replace(p_name, '([0-9])', '<\\1>', 'g') AS every FROM part")
def text_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return load(spark, sf_dir, "part").select(
        "p_partkey", text.concat(F.col("p_brand"), F.nullif(F.col("p_type"), F.lit("PROMO"))).alias("c"), text.left(name, -3).alias("l"), text.right(name, 4).alias("r"), text.substring(name, 0, 3).alias("s"),
        text.chr_(F.lit(960) + F.col("p_size")).alias("k"), text.to_hex(F.col("p_partkey")).alias("h"), text.to_bin(F.col("p_partkey")).alias("b"), text.strpos(name, "1").alias("i"),
        text.regexp_replace(name, "[0-9]", "#").alias("one"), text.regexp_replace(name, "([0-9])", r"<\1>", "g").alias("every"),
    )


@query("""SELECT * FROM (VALUES ('ab-cd eF', 'Ab-Cd Ef', '''ab-cd eF''', '"ab-cd eF"', 97, 'x=ab-cd eF %'), ('o''b', 'O''B', '''o''''b''', '"o''b"', 111, 'x=o''b %'), (NULL, NULL, 'NULL', NULL, NULL, 'x= %')) AS v(s, i, q, d, a, f)""")
def text_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    rows = spark.createDataFrame([("ab-cd eF",), ("o'b",), (None,)], "s string")
    return rows.select("s", text.initcap(s).alias("i"), text.quote_nullable(s).alias("q"), text.quote_ident(s).alias("d"), text.ascii_(s).alias("a"), text.format_("x=%s %%", s).alias("f"))


@query("SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS d, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS c, CAST(dayofweek(o_orderdate) AS INTEGER) AS w FROM orders")
def datetime_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select("o_orderkey", datetime.date_minus(F.lit("2000-01-01").cast("date"), t.cast("date")).cast("bigint").alias("d"), datetime.to_char(t, "YYYY-MM-DD HH24:MI").alias("c"), datetime.dow(t).alias("w"))


@query("SELECT event_id, CAST(datepart('year', a) * 12 + datepart('month', a) AS INTEGER) AS months, CAST(datepart('day', a) AS INTEGER) AS days FROM (SELECT event_id, age(ts, TIMESTAMP '2023-01-01 00:00:00') AS a FROM events)")
def age(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = datetime.age(F.col("ts"), F.lit("2023-01-01 00:00:00").cast("timestamp_ntz"))
    return load(spark, sf_dir, "events").select("event_id", a["months"].alias("months"), a["days"].alias("days"))


@query("SELECT n_nationkey, CAST((n_nationkey * 30) // 24 AS INTEGER) AS d, CAST((n_nationkey * 30) % 24 AS BIGINT) AS h, CAST((n_nationkey * 7) // 30 AS INTEGER) AS m, CAST((n_nationkey * 7) % 30 AS INTEGER) AS r FROM nation")
def justify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    hours = datetime.justify_hours(datetime.interval(0, 0, k * 30 * 3_600_000_000))
    days = datetime.justify_days(datetime.interval(0, k * 7, 0))
    return load(spark, sf_dir, "nation").select("n_nationkey", hours["days"].alias("d"), F.call_function("div", hours["micros"], F.lit(3_600_000_000)).alias("h"), days["months"].alias("m"), days["days"].alias("r"))


@query("SELECT p_partkey, a[2] AS second, a[9] AS none, array_to_string(a[2:3], ',') AS s, CAST(len(a) AS INTEGER) AS n, array_to_string(a, '+') AS j, '[1:' || len(a) || ']' AS d FROM (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part)")
def array_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = arrays.string_to_array(F.col("p_name"), " ")
    return load(spark, sf_dir, "part").select("p_partkey", arrays.subscript(a, 2).alias("second"), arrays.subscript(a, 9).alias("none"), F.array_join(arrays.slice_(a, 2, 3), ",").alias("s"), arrays.array_length(a).alias("n"), arrays.array_to_string(a, "+").alias("j"), arrays.array_dims(a).alias("d"))


@query("SELECT n_nationkey, lpad(to_binary(n_nationkey & 21), 5, '0') AS a, lpad(to_binary(n_nationkey | 10), 5, '0') AS o, lpad(to_binary(xor(n_nationkey, 31)), 5, '0') AS x, CAST(bit_count(n_nationkey) AS BIGINT) AS c, lpad(to_binary((n_nationkey << 2) & 31), 5, '0') AS l FROM nation")
def bit_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = numeric.bit_string(F.col("n_nationkey"), 5)
    return load(spark, sf_dir, "nation").select("n_nationkey", bits.bit_and(b, F.lit("10101")).alias("a"), bits.bit_or(b, F.lit("01010")).alias("o"), bits.bit_xor(b, F.lit("11111")).alias("x"), bits.bit_count(b).alias("c"), bits.shift_left(b, 2).alias("l"))


@query("""SELECT * FROM (VALUES (1, ' 1,234.50', '  I', ' 1ST'), (-7, '-7.00', '  ##', '-7')) AS v(k, c, r, t)""".replace("'  I'", "'              I'").replace("'  ##'", "'###############'").replace("' 1,234.50'", "'     1.00'").replace("'-7.00'", "'    -7.00'").replace("' 1ST'", "'   1ST'").replace("'-7')", "'  -7')"))
def to_char_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return spark.createDataFrame([(1,), (-7,)], "k int").select("k", format.to_char(k, "9,990.99").alias("c"), format.to_char(k, "RN").alias("r"), format.to_char(k, "999TH").alias("t"))


@query("SELECT * FROM (VALUES ('-1,234.5', CAST(-1234.5 AS DOUBLE)), ('12', 12)) AS v(s, n)")
def to_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("-1,234.5",), ("12",)], "s string").select("s", format.to_number(F.col("s"), "S9,999.9").cast("double").alias("n"))


same("text_more", "SELECT p_partkey, overlay(p_name PLACING 'xx' FROM 2 FOR 3) AS o, bit_length(p_name) AS b, octet_length(p_name) AS c, startswith(p_name, 'p') AS s, char_length(p_name) AS n, btrim(p_name, 'p') AS t, lower(hex(p_brand)) AS h FROM {part}",
     "SELECT p_partkey, left(p_name, 1) || 'xx' || substr(p_name, 5) AS o, CAST(bit_length(p_name) AS INTEGER) AS b, CAST(strlen(p_name) AS INTEGER) AS c, starts_with(p_name, 'p') AS s, CAST(length(p_name) AS INTEGER) AS n, trim(p_name, 'p') AS t, lower(hex(p_brand)) AS h FROM part")
same("json_populate_record", "SELECT event_id, r.k AS k, r.missing AS missing FROM (SELECT event_id, from_json(props, 'k INT, missing STRING') AS r FROM {events}) AS t", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
same("seconds_and_epoch", "SELECT event_id, unix_seconds(CAST(ts AS TIMESTAMP)) AS s, hour(ts) AS h, minute(ts) AS m, last_day(ts) AS l, months_between(TIMESTAMP_NTZ '2024-03-01 00:00:00', date_trunc('month', ts)) AS b FROM {events}", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS m, last_day(ts) AS l, CAST(date_diff('month', date_trunc('month', ts), TIMESTAMP '2024-03-01 00:00:00') AS DOUBLE) AS b FROM events")


@query("SELECT 55::BIGINT AS total, 10 AS rounds")
def sql_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A procedural body with variables and a loop, as a SQL script."""
    return spark.sql("BEGIN DECLARE total BIGINT DEFAULT 0; DECLARE k INT DEFAULT 0; WHILE k < 10 DO SET k = k + 1; SET total = total + k; END WHILE; SELECT total AS total, k AS rounds; END")
