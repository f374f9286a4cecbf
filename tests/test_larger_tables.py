"""Queries on tables that show what only larger ones than those of the tests would: large keys, few large groups, long texts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparrel.functions import tsearch
from sparrel.operators import joins
from sparrel.plans import registry
from tests.compare import connect, duck_rows, spark_rows


@pytest.fixture
def compared(spark, sf_dir, tmp_path):
    """A query's rows and those of its SQL, over a folder with tables of its own beside those of ``sf_dir``."""
    import os

    def run(name, **tables):
        for t, df in tables.items():
            df.write.parquet(f"{tmp_path}/{t}.parquet")
        for f in os.listdir(sf_dir):
            if not os.path.exists(tmp_path / f):
                os.symlink(f"{sf_dir}/{f}", tmp_path / f)
        return spark_rows(registry.queries()[name](spark, str(tmp_path))), duck_rows(connect(str(tmp_path)), registry.oracle_sql()[name])

    return run


def test_sum_exact_of_values_beyond_64_bits(spark, compared):
    """The key 775,808 and the query's constant make the first integer beyond 64 bits."""
    keys = spark.createDataFrame([(775_807, "A"), (775_808, "A"), (2**63 - 1, "B"), (-5, "B"), (None, "C")], "l_orderkey bigint, l_returnflag string")
    got, want = compared("sum_exact", lineitem=keys)
    assert got == want and ("B", str(2**63 - 1 - 5 + 2 * 9223372036854000000)) in got[1]


def test_ts_rank_is_sent_the_entries_of_the_query_alone(spark):
    """Not the whole vectors, which are many times as large; ranks are those of the whole vectors."""
    texts = [None, "", "thing", "of no " * 300 + "things that thing", "other words", "thing fish " * 100_000, "fish of a thing"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", tsearch.to_tsvector(F.col("t")).alias("v"))
    for query in ("thing", "thing & fish", "thi:* | !fish", "that"):
        q = tsearch.parse_query(query)
        for rank, value in ((tsearch.ts_rank, tsearch.rank_value), (tsearch.ts_rank_cd, tsearch.cover_density)):
            if q is None and rank is tsearch.ts_rank_cd:
                continue
            got = rows.select("k", rank(F.col("v"), q).alias("r"))
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "run(filter(" in plan
            whole = [None if x is None else value(x, q) for x in tsearch.vectors(pa.array(texts), "english").to_pylist()]
            assert [r["r"] for r in got.orderBy("k").collect()] == whole


@pytest.mark.parametrize("config", ["simple", "english"])
def test_tsvectors_are_made_a_slice_at_a_time(config):
    """Of a batch of 3 MB some hundred texts at once, with the rows of the whole batch; a long text, NULLs and empty batches, too."""
    texts = pa.array([None, "", "a long text " * 100_000, *(f"running text {k} " * 100 for k in range(1000)), None])
    parts = list(tsearch.sliced_vectors(iter([texts, texts[:0]]), config))
    assert max(len(p) for p in parts) < 400 and len(parts[-1]) == 0
    assert [v for p in parts for v in p.to_pylist()] == tsearch.vectors(texts, config).to_pylist()


def test_a_large_partition_is_written_by_several_tasks(spark, sf_dir, compared, tmp_path):
    """Nearly all rows are in the last partition. Read by four tasks, they are written by four."""
    orders = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("o_orderkey"))
    items = spark.range(0, 40_000, 1, 4).select((F.col("id") % 20_000).alias("l_orderkey"), F.floor(F.col("id") / 20_000).cast("int").alias("l_linenumber"))
    got, want = compared("partitioned_join", orders=orders, lineitem=items)
    assert got == want
    files = registry.queries()["partitioned_join"](spark, str(tmp_path)).inputFiles()
    for table in ("orders", "lineitem"):
        assert len([f for f in files if f"/{table}-" in f and "/part=3/" in f]) > 1


def test_range_join_compares_equal_ranges_once(spark, monkeypatch):
    """A join by bins of points with different ranges; their rows, NULLs and repeated ones, are told apart after it."""
    monkeypatch.setattr(joins, "MANY", 3)
    points = [(k, float(k % 7)) for k in range(20)] + [(20, None), (21, 100.0)]
    ranges = [(None if k == 5 else k // 2, float(k % 3), float(k % 3 + 2)) for k in range(30)] + [(99, None, 3.0), (98, 3.0, None), (97, 5.0, 4.0)]
    p, r = spark.createDataFrame(points, "k int, x double"), spark.createDataFrame(ranges, "id int, lo double, hi double")
    for inclusive in (True, False):
        want = [(k, x, *row) for k, x in points for row in ranges if None not in (x, *row[1:]) and row[1] <= x and (x <= row[2] if inclusive else x < row[2])]
        alone = [(k, x, None, None, None) for k, x in points if not any(w[0] == k for w in want)]
        for how, more in (("inner", []), ("left", alone)):
            got = joins.range_join(p, r, "x", "lo", "hi", 1.5, how, inclusive)
            assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want + more))
            assert got.columns == ["k", "x", "id", "lo", "hi"] and "collect_list" in got._jdf.queryExecution().executedPlan().toString()


def test_range_join_is_written_small(spark, tmp_path):
    """The rows of a range come again for each point, one point after the other, so a file holds few bytes a row."""
    p = spark.range(100).select("id", (F.col("id") % 97 + 100.0).alias("x"))
    r = spark.range(40_000).select(F.xxhash64("id").alias("key"), (F.col("id") % 20).cast("double").alias("lo"), (F.col("id") % 20 + 250.0).alias("hi"))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
    try:
        joins.range_join(p, r, "x", "lo", "hi", 300.0).select("id", "key").write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    got = spark.read.parquet(f"{tmp_path}/out")
    want = p.crossJoin(r.select("key"))
    digest = [F.count("*"), F.sum(F.xxhash64("id", "key").cast("decimal(38,0)"))]
    assert tuple(got.agg(*digest).first()) == tuple(want.agg(*digest).first()) and got.count() == 4_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 4_000_000


def test_range_join_deals_out_one_bin(spark):
    """Points of one bin, all with one value, are joined in several tasks."""
    p = spark.range(1000).select("id", (F.col("id") % 1 + 5.0).alias("x"))
    r = spark.createDataFrame([(k, 0.0, 9.0) for k in range(10)], "key int, lo double, hi double")
    for how in ("inner", "left"):
        got = joins.range_join(p, r, "x", "lo", "hi", 10.0, how)
        assert got.count() == 10_000 and got.select(F.spark_partition_id().alias("t")).distinct().count() > 1
