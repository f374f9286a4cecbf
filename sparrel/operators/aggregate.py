"""Aggregates that Spark lacks or defines otherwise, as Columns for agg() or as plans."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sparrel.functions import json


def array_agg(x: Column, order: Column | None = None, descending: bool = False) -> Column:
    """array_agg that keeps NULLs. ``order``: values come in its order, NULLs last."""
    if order is None:
        return F.transform(F.collect_list(F.struct(x.alias("x"))), lambda s: s["x"])
    held = F.collect_list(F.struct(order.isNull().alias("n"), order.alias("k"), x.alias("x")))
    ordered = F.sort_array(held, asc=not descending)
    return F.transform(ordered, lambda s: s["x"])


def string_agg(x: Column, separator: str, order: Column, descending: bool = False) -> Column:
    """string_agg with ORDER BY; NULL values are skipped, no value gives NULL."""
    held = F.collect_list(F.when(x.isNotNull(), F.struct(order.isNull().alias("n"), order.alias("k"), x.alias("x"))))
    parts = F.transform(F.sort_array(held, asc=not descending), lambda s: s["x"])
    return F.when(F.size(parts) > 0, F.array_join(parts, separator))


def json_agg(x: Column, order: Column | None = None) -> Column:
    """json_agg: NULLs stay; no row gives NULL."""
    return F.when(F.count("*") > 0, F.to_json(array_agg(x, order), {"ignoreNullFields": "false"}))


def json_arrayagg(x: Column, order: Column | None = None, absent: bool = True) -> Column:
    """JSON_ARRAYAGG(x ORDER BY order [NULL | ABSENT ON NULL]); no row gives NULL."""
    held = array_agg(F.coalesce(json.to_json(x), F.lit(None if absent else "null").cast("string")), order)
    return F.when(F.count("*") > 0, F.concat(F.lit("["), F.array_join(F.array_compact(held), ","), F.lit("]")))


def json_object_agg(key: Column, value: Column, absent: bool = False, unique: bool = False) -> Column:
    """json_object_agg and JSON_OBJECTAGG in order of keys and values; equal keys stay all, or are an error if ``unique``.

    ``absent``: without the pairs whose value is NULL. A NULL key is an error; no row gives NULL.
    """
    known = F.when(key.isNull(), F.raise_error(F.lit("field name must not be null")).cast("string")).otherwise(key.cast("string"))
    kept = value.isNotNull() | F.lit(not absent)
    pairs = F.sort_array(F.collect_list(F.when(kept, F.struct(known.alias("k"), F.coalesce(json.to_json(value), F.lit("null")).alias("v")))))
    text = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(json.scalar(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    if unique:
        keys = F.transform(pairs, lambda e: e["k"])
        text = F.when(F.size(keys) > F.size(F.array_distinct(keys)), F.raise_error(F.lit("duplicate JSON object key value")).cast("string")).otherwise(text)
    return F.when(F.count("*") > 0, text)


def jsonb_object_agg(key: Column, value: Column) -> Column:
    """As json_object_agg, with one pair for each key: the one with the largest value as text."""
    pairs = F.sort_array(F.collect_list(F.struct(key.cast("string").alias("k"), F.coalesce(json.to_json(value), F.lit("null")).alias("v"))))
    last = F.filter(pairs, lambda e, i: F.coalesce(F.get(pairs, i + 1)["k"] != e["k"], F.lit(True)))
    return F.when(F.count("*") > 0, F.concat(F.lit("{"), F.array_join(F.transform(last, lambda e: F.concat(json.scalar(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}")))


def hypothetical(kind: str, value: Column | float, x: Column) -> Column:
    """rank, dense_rank, percent_rank or cume_dist of a value among the group's x, in ascending order."""
    v = value if isinstance(value, Column) else F.lit(value)
    n, below, upto = F.count("*"), F.count_if(x < v), F.count_if(x <= v)
    return {
        "rank": (below + 1).cast("bigint"),
        "dense_rank": (F.count_distinct(F.when(x < v, x)) + 1).cast("bigint"),
        "percent_rank": F.when(n == 0, 0.0).otherwise(below / F.greatest(n, F.lit(1))),
        "cume_dist": (upto + 1) / (n + 1),
    }[kind]


def percentile_cont(fractions: float | list[float], x: Column) -> Column:
    """Interpolated percentile, or an array of them."""
    return F.percentile(x, F.array(*map(F.lit, fractions)) if isinstance(fractions, list) else F.lit(fractions))


def percentile_disc(fraction: float, column: str, descending: bool = False) -> Column:
    """The first value whose share of the group's rows reaches the fraction."""
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY `{column}`{' DESC' if descending else ''})")


def mode(x: Column) -> Column:
    """Most frequent value; the smallest of equally frequent ones."""
    return F.mode(x, True)


def range_agg(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Union of half-open ranges [low, high) by group: one row for each island (keys, low, high).

    Windows find where a range begins above all ends before it; NULL bounds and empty
    ranges are left out.
    """
    w = Window.partitionBy(*keys).orderBy(low, high)
    rows = df.filter(F.col(low) < F.col(high)).withColumn("__end", F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    begins = F.coalesce(F.col(low) > F.col("__end"), F.lit(True)).cast("int")
    island = rows.withColumn("__island", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "__island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("__island")


def range_intersect_agg(low: Column, high: Column) -> tuple[Column, Column]:
    """Bounds of the intersection of a group's ranges; empty if the first is not below the second."""
    return F.max(low), F.min(high)


def user_aggregate(step: Callable, start, final: Callable | None = None, returns: str = "double") -> Callable[..., Column]:
    """CREATE AGGREGATE: a transition function over a group's rows, with a start value and a final function.

    Rows come in no order, so the function should not depend on it. A strict step (None
    stays None) is the caller's matter. The result is a grouped aggregate over Arrow
    batches.
    """

    @pandas_udf(returns)
    def run(*columns: pd.Series) -> float:
        state = start
        for values in zip(*columns, strict=True):
            state = step(state, *values)
        return final(state) if final else state

    return run


def fold(x: Column, start: Column, step: Callable[[Column, Column], Column], final: Callable[[Column], Column] | None = None) -> Column:
    """CREATE AGGREGATE with Column expressions: no Python, but a group's values meet in one row."""
    return F.aggregate(F.collect_list(x), start, step, final) if final else F.aggregate(F.collect_list(x), start, step)


def variance_exact(x: Column, places: int = 6) -> Column:
    """Sample variance of integers or decimals by exact decimal sums."""
    d = x.cast("decimal(18,4)")
    n = F.count(x)
    s, q = F.sum(d), F.sum((d * d).cast("decimal(38,8)"))
    return F.when(n > 1, F.round(((q - s * s / n) / (n - 1)).cast("decimal(38,10)"), places))


def grouping_sets_distinct(df: DataFrame, sets: list[list[str]], **aggregates: Column) -> DataFrame:
    """GROUP BY DISTINCT of grouping sets: sets of the same columns count once."""
    kinds = list(dict.fromkeys(tuple(sorted(s)) for s in sets))
    columns = [c for c in df.columns if any(c in s for s in kinds)]
    return df.groupingSets([[F.col(c) for c in s] for s in kinds], *columns).agg(*(a.alias(n) for n, a in aggregates.items()))


def rollup_sets(*columns: str) -> list[list[str]]:
    return [list(columns[:k]) for k in range(len(columns), -1, -1)]


def sum_exact(x: Column) -> Column:
    """sum(bigint), or of decimals without a fraction of up to 28 digits: a decimal that does not overflow.

    An argument that may leave 64 bits itself is to be a decimal before that.
    """
    return F.sum(x.cast("decimal(28,0)"))


def bit_text_and(x: Column) -> Column:
    """bit_and of bit strings of one length: a place is 1 if it is in all."""
    return _bit_text(x, F.array_min)


def bit_text_or(x: Column) -> Column:
    """bit_or of bit strings of one length."""
    return _bit_text(x, F.array_max)


def _bit_text(x: Column, of) -> Column:
    kinds = F.collect_set(x)  # as many as there are different strings
    places = F.sequence(F.lit(1), F.max(F.length(x)))
    return F.when(F.count(x) > 0, F.array_join(F.transform(places, lambda k: of(F.transform(kinds, lambda b: F.substr(b, k, F.lit(1))))), ""))
