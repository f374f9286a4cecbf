"""DISTINCT ON, set-returning functions in select lists, WITH ORDINALITY, set operations, recursion."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sparrel.stored import folder, settle, settle_counted


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group of keys, in the given order within it.

    The order goes on after the keys, which a query text would have to begin with.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def project_set(df: DataFrame, keep: list[str], **arrays: Column) -> DataFrame:
    """Several set-returning functions in a select list: zipped, the shorter ones padded with NULL. Rows with no element at all vanish."""
    names = list(arrays)
    zipped = F.arrays_zip(*(F.coalesce(a, F.array()).alias(n) for n, a in arrays.items()))
    out = df.select(*keep, F.explode(zipped).alias("__z"))
    return out.select(*keep, *(F.col("__z").getField(n).alias(n) for n in names))


def with_ordinality(df: DataFrame, keep: list[str], array: Column, name: str = "value", number: str = "ordinality") -> DataFrame:
    """Elements with their number from 1, as bigint."""
    out = df.select(*keep, F.posexplode(array).alias("__p", name))
    return out.select(*keep, name, (F.col("__p") + 1).cast("bigint").alias(number))


def generate_series(start: Column | int, stop: Column | int, step: Column | int = 1) -> Column:
    """Elements of a series as an array; empty if the step leads away; a step of 0 is an error; NULL gives none."""
    a, b, s = (x if isinstance(x, Column) else F.lit(x) for x in (start, stop, step))
    fits = ((s > 0) & (a <= b)) | ((s < 0) & (a >= b))
    kind = "array<bigint>"
    zero = F.raise_error(F.lit("step size cannot equal zero")).cast("bigint")
    safe = F.when(fits, s).otherwise(F.when(a <= b, F.lit(1)).otherwise(F.lit(-1)))
    return F.when(s == 0, F.array(zero)).when(fits, F.sequence(a.cast("bigint"), b.cast("bigint"), safe.cast("bigint")).cast(kind)).otherwise(F.array().cast(kind))


def union(*branches: DataFrame, all: bool = False) -> DataFrame:  # noqa: A002
    out = branches[0]
    for b in branches[1:]:
        out = out.union(b)
    return out if all else out.distinct()


#: Rows of a recursive query up to which what was seen is joined as it was written; beyond them it is kept in buckets.
FEW_SEEN = 1_000_000


def recursive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, most: int = 10_000) -> DataFrame:
    """WITH RECURSIVE: rows that the step adds to the last round's rows, until there are none.

    ``distinct`` (UNION): rows that were there before do not come again, so that
    cycles end. Each round is written to ``spark.checkpoint.dir`` (a local folder if
    that is unset) and read again. More rounds than ``most`` are an error.
    """
    new, total = settle_counted(seed.distinct() if distinct else seed, "recursive")
    seen = new
    for number in range(1, most + 1):
        if distinct and total > FEW_SEEN:
            return _closure(seen, new, step, most - number + 1)
        more = step(new).toDF(*seed.columns)
        if distinct:
            old = seen.toDF(*(f"__{c}" for c in seed.columns))
            more = more.distinct().join(old, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in seed.columns], "left_anti")
        new, added = settle_counted(more, "recursive")
        if not added:
            return seen
        seen, total = seen.unionAll(new), total + added
        if number % 16 == 0:
            seen = settle(seen, "recursive")
    raise RuntimeError("recursive query does not end")


def _closure(seen: DataFrame, new: DataFrame, step: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """Further rounds as partitions of one table in buckets by a hash of the row, so that what was seen is joined without a shuffle."""
    spark, columns = seen.sparkSession, seen.columns
    name, path = f"recursive_{uuid.uuid4().hex}", folder(spark, "recursive")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = lambda df: df.withColumn("__h", F.xxhash64(*columns))

    def add(rows: DataFrame, number: int) -> int:
        told = Observation()
        counted = rows.select(*columns, "__h", F.lit(number).alias("__round")).observe(told, F.count(F.lit(1)).alias("n"))
        counted.write.mode("append").format("parquet").option("path", path).partitionBy("__round").bucketBy(buckets, "__h").saveAsTable(name)
        return told.get["n"]

    add(hashed(seen).repartition(buckets, "__h"), 0)
    try:
        for number in range(1, most + 1):
            table = spark.table(name)
            more = hashed(step(new).toDF(*columns).distinct())
            old = table.drop("__round").toDF(*(f"__{c}" for c in columns), "__old")
            # the hash is the only key of the join: two comparisons in place of an equality, which would become one
            here, there = F.struct(*columns), F.struct(*(F.col(f"__{c}").alias(c) for c in columns))
            same = (here >= there) & (here <= there)
            if not add(more.join(old, (F.col("__h") == F.col("__old")) & same, "left_anti"), number):
                return spark.read.schema(table.schema).parquet(path).select(columns)
            new = spark.table(name).filter(F.col("__round") == number).select(columns)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay
    raise RuntimeError("recursive query does not end")


def rows_from(*arrays: Column, ordinality: bool = False) -> Column:
    """ROWS FROM (f(), g(), ...) [WITH ORDINALITY] and unnest(a, b, ...): an array of structs to be inlined, padded with NULL."""
    zipped = F.arrays_zip(*(F.coalesce(a, F.array()).alias(f"c{k}") for k, a in enumerate(arrays, 1)))
    if not ordinality:
        return zipped
    return F.transform(zipped, lambda z, k: F.struct(*(z[f"c{n}"].alias(f"c{n}") for n in range(1, len(arrays) + 1)), (k + 1).cast("bigint").alias("ordinality")))


def limit_offset(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """LIMIT and OFFSET; negative numbers are errors, NULL is no limit."""
    if limit is not None and limit < 0:
        raise ValueError("LIMIT must not be negative")
    if offset < 0:
        raise ValueError("OFFSET must not be negative")
    out = df.offset(offset) if offset else df
    return out if limit is None else out.limit(limit)
