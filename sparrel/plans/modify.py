"""INSERT, ON CONFLICT, UPDATE, DELETE and MERGE with repeated and NULL keys, RETURNING, constraints, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.operators import dml
from sparrel.operators.dml import When
from sparrel.plans.catalogue import query
from sparrel.session import load

_MANY = "(SELECT nullif(l_suppkey % 40, 7) AS k, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY 1)"
_ROWS = "(SELECT nullif(l_suppkey % 40, 7) AS k, round(l_extendedprice, 2) AS v FROM lineitem WHERE l_linenumber = 4)"
_T = "(SELECT nullif(s_suppkey + 20, 28) AS k, round(s_acctbal, 2) AS v FROM supplier)"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A target with a NULL key, a source with one row for each key, and one with many."""
    key, line = F.expr("nullif(l_suppkey % 40, 7)").alias("k"), load(spark, sf_dir, "lineitem")
    target = load(spark, sf_dir, "supplier").select(F.expr("nullif(s_suppkey + 20, 28)").alias("k"), F.round("s_acctbal", 2).alias("v"))
    return target, line.groupBy(key).agg(F.round(F.sum("l_quantity"), 2).alias("v")), line.filter("l_linenumber = 4").select(key, F.round("l_extendedprice", 2).alias("v"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, 9 FROM region")
def insert_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return dml.insert(load(spark, sf_dir, "nation"), rows, {"n_regionkey": F.lit(9)})[0]


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT length(r_name) + 500, r_name, NULL FROM region UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region")
def insert_overriding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OVERRIDING USER VALUE takes the identity's own value, OVERRIDING SYSTEM VALUE the given one."""
    rows = load(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    identity = {"n_nationkey": F.length("r_name") + 500}
    named = rows.withColumn("r_name", F.col("n_name"))
    first, _ = dml.insert(load(spark, sf_dir, "nation"), named, identity, ("n_nationkey",), "user")
    return dml.insert(first, named, identity, ("n_nationkey",), "system")[0]


@query("SELECT CAST(NULL AS VARCHAR) AS before, r_name AS after, r_regionkey + 100 AS id FROM region")
def insert_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return dml.insert(load(spark, sf_dir, "nation"), rows)[1].select(F.col("old.n_name").alias("before"), F.col("new.n_name").alias("after"), F.col("new.n_nationkey").alias("id"))


@query(f"SELECT k, v FROM {_T} UNION ALL SELECT k, v FROM {_ROWS} WHERE k IS NULL UNION ALL SELECT k, min(v) FROM {_ROWS} WHERE k NOT IN (SELECT k FROM {_T} WHERE k IS NOT NULL) GROUP BY k")
def on_conflict_nothing_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys are inserted once, NULL keys each."""
    target, _, rows = _tables(spark, sf_dir)
    return dml.on_conflict(target, rows, ["k"])[0]


@query(f"SELECT t.k, round(CASE WHEN s.k IS NULL THEN t.v ELSE t.v + s.v END, 2) AS v FROM {_T} t LEFT JOIN {_MANY} s ON t.k = s.k UNION ALL SELECT k, v FROM {_MANY} s WHERE NOT EXISTS (SELECT 1 FROM {_T} t WHERE t.k = s.k)")
def on_conflict_update_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, one, _ = _tables(spark, sf_dir)
    return dml.on_conflict(target, one, ["k"], "update", {"v": F.round(F.col("t.v") + F.col("s.v"), 2)})[0]


@query(f"SELECT t.k AS old_k, t.v AS old_v, coalesce(t.k, s.k) AS new_k, coalesce(s.v, t.v) AS new_v FROM {_MANY} s LEFT JOIN {_T} t ON t.k = s.k WHERE t.k IS NULL OR t.v < s.v")
def on_conflict_update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, one, _ = _tables(spark, sf_dir)
    told = dml.on_conflict(target, one, ["k"], "update", {"v": F.col("s.v")}, F.col("t.v") < F.col("s.v"))[1]
    return told.select(F.col("old.k").alias("old_k"), F.col("old.v").alias("old_v"), F.col("new.k").alias("new_k"), F.col("new.v").alias("new_v"))


@query(f"SELECT coalesce(t.k, s.k) AS k, CASE WHEN t.k IS NULL THEN s.v ELSE t.v END AS v, t.k IS NOT NULL AS was_there FROM {_MANY} s LEFT JOIN {_T} t ON t.k = s.k")
def on_conflict_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, one, _ = _tables(spark, sf_dir)
    return dml.on_conflict(target, one, ["k"], "select")[1].select("new.k", "new.v", F.col("old").isNotNull().alias("was_there"))


@query(f"SELECT t.k, coalesce(s.v, t.v) AS v FROM {_T} t LEFT JOIN (SELECT k, min(v) AS v FROM {_ROWS} WHERE k IS NOT NULL GROUP BY k) s ON t.k = s.k")
def update_from_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several source rows for a key leave one target row."""
    target, _, rows = _tables(spark, sf_dir)
    return dml.update_from(target, rows, ["k"], {"v": F.col("s.v")})


@query(f"SELECT t.k, t.v AS before, round(t.v - s.v, 2) AS after FROM {_T} t JOIN {_MANY} s ON t.k = s.k")
def update_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, one, _ = _tables(spark, sf_dir)
    told = dml.update_returning(target, one, ["k"], {"v": F.round(F.col("t.v") - F.col("s.v"), 2)})[1]
    return told.select("new.k", F.col("old.v").alias("before"), F.col("new.v").alias("after"))


@query(f"SELECT k, v FROM {_T} WHERE k IN (SELECT k FROM {_ROWS} WHERE v > 20000)")
def delete_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, _, rows = _tables(spark, sf_dir)
    return dml.delete_returning(target, rows.filter("v > 20000"), ["k"])[1].select("old.*")


@query("SELECT 'left' AS place, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE NOT o_totalprice < 50000 UNION ALL SELECT 'archive', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_totalprice < 50000")
def modifying_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WITH moved AS (DELETE ... RETURNING *), INSERT INTO archive SELECT FROM moved: both states, from one read of the table."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    left, told = dml.delete_returning(orders, orders.filter("o_totalprice < 50000"), ["o_orderkey"])
    archive, _ = dml.insert(dml.truncate(orders), told.select("old.*"))
    totals = lambda t, place: t.agg(F.lit(place).alias("place"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return totals(left, "left").unionByName(totals(archive, "archive"))


@query("SELECT CAST(0 AS BIGINT) AS kept, count(*) AS added FROM region")
def truncate_and_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = dml.truncate(load(spark, sf_dir, "nation"))
    rows = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return dml.insert(empty, rows)[0].agg(F.count("n_regionkey").alias("kept"), F.count("*").alias("added"))


@query("""SELECT c.c_custkey, CASE WHEN o.k IS NOT NULL THEN round(c.c_acctbal + o.total, 2) ELSE c.c_acctbal END AS c_acctbal FROM customer c LEFT JOIN (SELECT o_custkey AS k, round(max(o_totalprice), 2) AS total FROM orders GROUP BY 1) o ON c.c_custkey = o.k AND o.total > c.c_acctbal * 20
UNION ALL SELECT o.k + 1000000, o.total FROM (SELECT o_custkey AS k, round(max(o_totalprice), 2) AS total FROM orders GROUP BY 1) o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.k AND o.total > c.c_acctbal * 20)""")
def merge_on_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MERGE ... ON equal keys AND a comparison: rows that fail the comparison are not matched."""
    target = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    source = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("total"))
    whens = [When(True, "update", None, {"c_acctbal": F.round(F.col("t.c_acctbal") + F.col("s.total"), 2)}), When(False, "insert", None, {"c_custkey": F.col("s.c_custkey") + 1000000, "c_acctbal": F.col("s.total")})]
    return dml.merge(target, source, ["c_custkey"], whens, F.col("s.total") > F.col("t.c_acctbal") * 20)[0]


@query("SELECT merge_action, count(*) AS n FROM (SELECT CASE WHEN t.k IS NULL THEN 'INSERT' ELSE 'DELETE' END AS merge_action FROM (SELECT n_nationkey AS k FROM nation) t RIGHT JOIN (SELECT r_regionkey * 6 AS lo FROM region) s ON t.k = s.lo + 1) GROUP BY 1")
def merge_any_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MERGE without equal keys."""
    target = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    source = load(spark, sf_dir, "region").select((F.col("r_regionkey") * 6).alias("lo"))
    _, acts = dml.merge(target, source, [], [When(True, "delete"), When(False, "insert", None, {"k": F.col("s.lo")})], (F.col("t.k") > F.col("s.lo")) & (F.col("t.k") <= F.col("s.lo") + 1))
    return acts.groupBy("merge_action").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE NOT (CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END > 20000)")
def check_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL passes a CHECK."""
    return dml.check_violations(load(spark, sf_dir, "orders"), F.expr("CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END > 20000")).select("o_orderkey")


@query("""WITH p AS (SELECT s_nationkey AS k, s_suppkey % 50 AS lo, s_suppkey % 50 + 6 AS hi FROM supplier), c AS (SELECT c_custkey, c_nationkey AS k, c_custkey % 50 AS lo, c_custkey % 50 + 8 AS hi FROM customer),
i AS (SELECT k, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(CASE WHEN lo > e THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM p)) GROUP BY k, g)
SELECT c_custkey FROM c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.k = c.k AND i.lo <= c.lo AND c.hi <= i.hi)""")
def period_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FOREIGN KEY ... PERIOD: a child's range lies in the union of its parents' ranges."""
    p = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 50).alias("lo"), (F.col("s_suppkey") % 50 + 6).alias("hi"))
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 50).alias("lo"), (F.col("c_custkey") % 50 + 8).alias("hi"))
    return dml.period_violations(c, p, ["k"], "lo", "hi").select("c_custkey")


_CELLS = "(SELECT 'p_brand' AS column_name, p_brand AS v FROM part UNION ALL SELECT 'p_size', CAST(nullif(p_size, 7) AS VARCHAR) FROM part)"


@query(f"""SELECT column_name, v AS common_value, CAST(k AS BIGINT) AS place, n / total AS frequency FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS k FROM (SELECT column_name, v, count(*) AS n FROM {_CELLS} WHERE v IS NOT NULL GROUP BY ALL)) JOIN (SELECT column_name, count(*) AS total FROM {_CELLS} GROUP BY 1) USING (column_name) WHERE k <= 10""")
def analyze_common_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select("p_brand", F.expr("nullif(p_size, 7)").alias("p_size"))
    zipped = dml.analyze(p, ["p_brand", "p_size"]).select("column_name", F.posexplode(F.arrays_zip("most_common_vals", "most_common_freqs")).alias("k", "z"))
    return zipped.select("column_name", F.col("z.most_common_vals").alias("common_value"), (F.col("k") + 1).cast("bigint").alias("place"), F.col("z.most_common_freqs").alias("frequency"))


@query("SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS k, unnest(b) AS bound FROM (SELECT quantile_disc(l_linenumber, [0.0, 0.25, 0.5, 0.75, 1.0]) AS b FROM lineitem)")
def analyze_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dml.analyze(load(spark, sf_dir, "lineitem").select("l_linenumber"), ["l_linenumber"], bounds=4)
    return got.select(F.posexplode("histogram_bounds").alias("k", "bound")).select(F.col("k").cast("bigint").alias("k"), F.col("bound").cast("int").alias("bound"))


@query("""SELECT 'n_nationkey' AS a, 'n_regionkey' AS b, count(DISTINCT (n_nationkey, n_regionkey)) AS ndistinct, 1.0::DOUBLE AS degree FROM nation
UNION ALL SELECT 'n_regionkey', 'n_nationkey', count(DISTINCT (n_nationkey, n_regionkey)), (SELECT coalesce(sum(CASE WHEN k = 1 THEN n ELSE 0 END), 0) / sum(n) FROM (SELECT count(*) AS n, count(DISTINCT n_nationkey) AS k FROM nation GROUP BY n_regionkey)) FROM nation""")
def extended_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.dependencies(load(spark, sf_dir, "nation"), [("n_nationkey", "n_regionkey"), ("n_regionkey", "n_nationkey")])
