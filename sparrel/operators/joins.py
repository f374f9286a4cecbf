"""Joins that Spark has no form of: FULL USING with merged keys, range joins by bins, top rows for each outer row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def full_using(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """FULL JOIN USING: keys come first and once, with the value of the side that has one."""
    r = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    cond = None
    for k in keys:
        one = F.col(k) == F.col(f"__{k}")
        cond = one if cond is None else cond & one
    joined = left.join(r, cond, "full")
    rest = [c for c in left.columns if c not in keys] + [c for c in right.columns if c not in keys]
    return joined.select(*(F.coalesce(k, f"__{k}").alias(k) for k in keys), *rest)


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """NATURAL JOIN: by all columns of the same name; a cross join if there is none."""
    keys = [c for c in left.columns if c in right.columns]
    if not keys:
        return left.crossJoin(right)
    return full_using(left, right, keys) if how == "full" else left.join(right, keys, how)


#: Rows with one range that are kept in one array at most, about: few, so that a page of a written file holds an array many times.
MANY = 256
#: Parts in which the points of a bin are joined.
PIECES = 16


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, how: str = "inner", inclusive: bool = True) -> DataFrame:
    """Rows where low <= point <= high (point < high unless ``inclusive``), as an equi-join on bins of ``width``.

    A range is repeated for each bin that it meets, so the plan hashes or sorts by bin
    and never compares all pairs. Rows with one range are compared once, as an array, and
    told apart after the join; those of more than MANY rows as several. An inner join runs
    through its ranges and gives an array for one point after the other, so that the many
    rows of a result repeat and take little room where they are written. A bin's points are
    dealt out over PIECES tasks at most, as a few bytes of them can have many matches; its
    ranges go to each of those. NULL bounds match nothing. ``how``: inner or left.
    """
    name = lambda c: F.col(f"`{c}`")
    rest = [c for c in ranges.columns if c not in (low, high)]
    held = ranges.filter(F.col(low) <= F.col(high)).select(F.col(low).alias("__low"), F.col(high).alias("__high"), F.struct(*(map(name, rest) if rest else [F.lit(True)])).alias("__row"))
    parts = held.groupBy("__low", "__high").agg(F.ceil(F.count("*") / F.lit(MANY)).alias("__parts")).filter("__parts > 1")
    part = F.pmod(F.xxhash64("__row"), F.coalesce("__parts", F.lit(1))).alias("__part")
    r = held.join(parts, ["__low", "__high"], "left").groupBy("__low", "__high", part).agg(F.collect_list("__row").alias("__rows"))
    single = len(rest) == 1
    if single:
        r = r.withColumn("__rows", F.transform("__rows", lambda x: x[rest[0]]))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = r.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__low") / width), F.floor(F.col("__high") / width))))
    r = r.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1)))).repartition(tasks, "__bin", "__piece")
    p = points if how == "left" else points.filter(F.col(point).isNotNull())
    p = p.repartition(tasks).withColumns({"__bin": F.floor(F.col(point) / width), "__piece": F.pmod(F.spark_partition_id(), F.lit(PIECES))}).repartition(tasks, "__bin", "__piece")
    below = F.col(point) <= F.col("__high") if inclusive else F.col(point) < F.col("__high")
    same = (p["__bin"] == r["__bin"]) & (p["__piece"] == r["__piece"])
    joined = r.hint("merge").join(p, same & (F.col(point) >= F.col("__low")) & below, "right" if how == "left" else how)
    each = F.explode_outer("__rows") if how == "left" else F.explode("__rows")
    out = joined.select(*map(name, points.columns), "__low", "__high", each.alias("__row"))
    bounds = {low: "__low", high: "__high"}
    return out.select(*map(name, points.columns), *(F.col(bounds[c]).alias(c) if c in bounds else (F.col("__row") if single else F.col("__row")[c]).alias(c) for c in ranges.columns))


def overlap_join(a: DataFrame, b: DataFrame, a_low: str, a_high: str, b_low: str, b_high: str, width: float) -> DataFrame:
    """Pairs of overlapping half-open ranges [low, high): each pair once, in the first bin that both meet."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / width), F.greatest(F.ceil(F.col(hi) / width) - 1, F.floor(F.col(lo) / width)))
    x = a.filter(F.col(a_low) < F.col(a_high)).withColumn("__bin", F.explode(span(a_low, a_high)))
    y = b.filter(F.col(b_low) < F.col(b_high)).withColumn("__bin", F.explode(span(b_low, b_high)))
    first = F.floor(F.greatest(F.col(a_low), F.col(b_low)) / width) == x["__bin"]
    return x.join(y, (x["__bin"] == y["__bin"]) & (F.col(a_low) < F.col(b_high)) & (F.col(b_low) < F.col(a_high)) & first).drop("__bin")


def lateral_top(outer: DataFrame, inner: DataFrame, keys: dict[str, str], order: list[Column], n: int, how: str = "inner") -> DataFrame:
    """LATERAL (SELECT ... WHERE inner key = outer key ORDER BY ... LIMIT n): top rows first, then one equi-join.

    ``keys``: outer column to inner column. ``how`` 'left' keeps outer rows without any.
    """
    w = Window.partitionBy(*keys.values()).orderBy(*order)
    top = inner.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")
    cond = None
    for o, i in keys.items():
        one = outer[o] == top[i]
        cond = one if cond is None else cond & one
    return outer.join(top, cond, how)


def semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """EXISTS."""
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """NOT EXISTS: rows with NULL keys stay."""
    return left.join(right, on, "left_anti")


def all_of(left: DataFrame, value: str, right: DataFrame, column: str, op: str) -> DataFrame:
    """value op ALL (SELECT column): by the subquery's extreme, with NULLs as in SQL. ``op``: < <= > >=."""
    ends = right.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count_if(F.col(column).isNull()).alias("nulls"), F.count("*").alias("n"))
    v = F.col(value)
    test = {"<": v < F.col("lo"), "<=": v <= F.col("lo"), ">": v > F.col("hi"), ">=": v >= F.col("hi")}[op]
    return left.crossJoin(F.broadcast(ends)).filter((F.col("n") == 0) | (test & (F.col("nulls") == 0))).select(left.columns)


def any_of(left: DataFrame, value: str, right: DataFrame, column: str, op: str) -> DataFrame:
    """value op ANY (SELECT column). ``op``: = < <= > >=."""
    if op == "=":
        return left.join(right, left[value] == right[column], "left_semi")
    ends = right.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    v = F.col(value)
    test = {"<": v < F.col("hi"), "<=": v <= F.col("hi"), ">": v > F.col("lo"), ">=": v >= F.col("lo")}[op]
    return left.crossJoin(F.broadcast(ends)).filter(test).select(left.columns)
