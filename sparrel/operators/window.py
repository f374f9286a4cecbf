"""Window frames that Spark lacks: GROUPS, and EXCLUDE.

GROUPS counts groups of peers, so a dense rank makes it a RANGE frame. EXCLUDE is
algebra over frames: the frame's aggregate without that of the excluded rows for
sums and counts. Least and greatest collect the frame of each row, so those are for
frames of few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


def with_groups(df: DataFrame, partition: list[str], order: list[Column], name: str = "__group") -> DataFrame:
    """Adds the number of each row's peer group, for frames in GROUPS."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))


def groups_between(partition: list[str], start: int, end: int, name: str = "__group"):
    """The frame GROUPS BETWEEN start AND end (negative: preceding) over with_groups()."""
    return Window.partitionBy(*partition).orderBy(name).rangeBetween(start, end)


def over_groups(df: DataFrame, partition: list[str], order: list[Column], start: int, end: int, **aggregates: Column) -> DataFrame:
    """Aggregates over a GROUPS frame as new columns."""
    frame = groups_between(partition, start, end)
    out = with_groups(df, partition, order)
    return out.select("*", *(a.over(frame).alias(n) for n, a in aggregates.items())).drop("__group")


def over_excluding(df: DataFrame, partition: list[str], order: list[Column], tie_break: list[Column], start: int, end: int, exclude: str, value: str, *names: str) -> DataFrame:
    """Aggregates of ``value`` over ROWS BETWEEN start AND end EXCLUDE ``exclude``.

    ``exclude``: current row, group, ties or no others. ``names``: of sum, count, avg,
    min, max; new columns have these names. ``tie_break`` makes the order of rows
    definite, and with it what a frame of rows holds.
    """
    rows = Window.partitionBy(*partition).orderBy(*order, *tie_break)
    out = df.withColumn("__row", F.row_number().over(rows)).withColumn("__rank", F.rank().over(Window.partitionBy(*partition).orderBy(*order)))
    v, row = F.col(value), F.col("__row")
    low = F.lit(1) if start <= FIRST else row + start
    high = F.lit(1 << 40) if end >= LAST else row + end
    frame = Window.partitionBy(*partition).orderBy("__row").rowsBetween(start, end)
    if exclude == "current row":
        inside = (row >= low) & (row <= high)
        gone_sum, gone_count = F.when(inside, F.coalesce(v, F.lit(0))).otherwise(0), F.when(inside & v.isNotNull(), 1).otherwise(0)
    elif exclude in ("group", "ties"):
        # peers stand side by side, so the frame's peers are the same frame within them
        near = Window.partitionBy(*partition, "__rank").orderBy("__row").rowsBetween(start, end)
        gone_sum, gone_count = F.coalesce(F.sum(v).over(near), F.lit(0)), F.count(v).over(near)
        if exclude == "ties":
            inside = (row >= low) & (row <= high)
            gone_sum, gone_count = gone_sum - F.when(inside, F.coalesce(v, F.lit(0))).otherwise(0), gone_count - F.when(inside & v.isNotNull(), 1).otherwise(0)
    else:
        gone_sum, gone_count = F.lit(0), F.lit(0)
    n = F.count(v).over(frame) - gone_count
    total = F.coalesce(F.sum(v).over(frame), F.lit(0)) - gone_sum
    made = {"count": n, "sum": F.when(n > 0, total), "avg": F.when(n > 0, total / F.when(n > 0, n))}
    if {"min", "max"} & set(names):
        held = F.collect_list(F.struct(F.col("__row").alias("r"), F.col("__rank").alias("k"), v.alias("v"))).over(frame)
        outside = {"no others": lambda s: F.lit(True), "current row": lambda s: s["r"] != row, "group": lambda s: s["k"] != F.col("__rank"), "ties": lambda s: (s["k"] != F.col("__rank")) | (s["r"] == row)}[exclude]
        left = F.transform(F.filter(held, outside), lambda s: s["v"])
        made |= {"min": F.array_min(left), "max": F.array_max(left)}
    hidden = [c for c in out.columns if c.startswith("__")]
    return out.select("*", *(made[k].alias(k) for k in names)).drop(*hidden)


def filtered(x: Column, condition: Column) -> Column:
    """FILTER (WHERE ...) of a windowed aggregate: the argument where the condition is true."""
    return F.when(condition, x)
