"""DML as functions from tables to tables: INSERT, ON CONFLICT, MERGE, UPDATE FROM, DELETE USING, constraints, differences.

Functions with two results give the new table and what RETURNING sees: (old struct,
new struct), NULL where there is none.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from sparrel.stored import settle


@dataclass
class When:
    """A MERGE clause. ``matched``: True, False (not matched by target) or "source" (not matched by source).

    ``action``: update, insert, delete or nothing. ``values``: column to expression over t.* and s.*.
    """

    matched: bool | str
    action: str
    condition: Column | None = None
    values: dict[str, Column] = field(default_factory=dict)


def _equal(keys: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}{k}") == F.col(f"{b}{k}") for k in keys))


def merge(target: DataFrame, source: DataFrame, keys: list[str], whens: list[When], on: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The new table, and what RETURNING merge_action() sees: (merge_action, old struct, new struct).

    Target and source are joined once, as t and s, on equal ``keys`` and the condition
    ``on`` over t.* and s.*. Without keys, each row is compared with all of the other
    table. The first clause that applies to a row acts. Two source rows for one target
    row that is changed are an error.
    """
    cols = target.columns
    t = target.select(F.struct(*cols).alias("t"), *(F.col(k).alias(f"__t_{k}") for k in keys), F.monotonically_increasing_id().alias("__id"))
    s = source.select(F.struct(*source.columns).alias("s"), *(F.col(k).alias(f"__s_{k}") for k in keys))
    terms = ([_equal(keys, "__t_", "__s_")] if keys else []) + ([on] if on is not None else [])
    both = t.join(s, reduce(lambda a, b: a & b, terms), "full")
    state = {True: F.col("t").isNotNull() & F.col("s").isNotNull(), False: F.col("t").isNull(), "source": F.col("s").isNull()}
    number = F.lit(-1)
    for k in reversed(range(len(whens))):
        w = whens[k]
        hit = state[w.matched] if w.condition is None else state[w.matched] & F.coalesce(w.condition, F.lit(False))
        number = F.when(hit, F.lit(k)).otherwise(number)
    both = both.withColumn("__when", number)
    kind = {c: target.schema[c].dataType for c in cols}
    new = F.col("t")
    for k, w in enumerate(whens):
        if w.action in ("update", "insert"):
            made = F.struct(*((w.values[c] if c in w.values else F.col(f"t.{c}") if w.action == "update" else F.lit(None)).cast(kind[c]).alias(c) for c in cols))
            new = F.when(F.col("__when") == k, made).otherwise(new)
        elif w.action == "delete":
            new = F.when(F.col("__when") == k, F.lit(None)).otherwise(new)
    acts = [k for k, w in enumerate(whens) if w.action != "nothing"]
    action = F.lit(None).cast("string")
    for k in acts:
        action = F.when(F.col("__when") == k, F.lit(whens[k].action.upper())).otherwise(action)
    both = both.withColumn("new", new).withColumn("merge_action", action)
    # rows of one target row meet; rows without one are spread by their source
    row = Window.partitionBy("__id", F.when(F.col("__id").isNull(), F.xxhash64("s")))
    acted, mine = F.col("merge_action").isNotNull(), F.col("t").isNotNull()
    both = both.withColumn("__acts", F.count(F.when(acted & mine & F.col("s").isNotNull(), 1)).over(row)).withColumn("__n", F.row_number().over(row.orderBy(~acted)))
    twice = F.raise_error(F.lit("MERGE command cannot affect row a second time")).cast("boolean")
    both = both.filter(F.when(F.col("__acts") > 1, twice).otherwise(F.lit(True)))
    table = both.filter(F.col("new").isNotNull() & (~mine | (F.col("__n") == 1))).select("new.*")
    return table, both.filter(acted).select("merge_action", F.col("t").alias("old"), "new")


def insert(target: DataFrame, source: DataFrame, defaults: dict[str, Column] | None = None, always: tuple[str, ...] = (), overriding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """INSERT: columns that the source lacks get their default, or NULL.

    ``always``: identity columns GENERATED ALWAYS. A source that has one is an error,
    unless ``overriding`` is "system" (its values are taken) or "user" (they are not).
    """
    given = [c for c in source.columns if c in always]
    if given and overriding is None:
        raise ValueError(f"cannot insert a non-DEFAULT value into column {given[0]!r}")
    taken = [c for c in target.columns if c in source.columns and not (overriding == "user" and c in always)]
    made = {c: F.col(c) for c in taken}
    new = source.select(*(made.get(c, (defaults or {}).get(c, F.lit(None))).cast(target.schema[c].dataType).alias(c) for c in target.columns))
    return target.unionByName(new), new.select(_none(target).alias("old"), F.struct(*target.columns).alias("new"))


def _none(table: DataFrame) -> Column:
    return F.lit(None).cast(table.schema)


def _set(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))


def on_conflict(target: DataFrame, source: DataFrame, keys: list[str], action: str = "nothing", update: dict[str, Column] | None = None, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """INSERT ... ON CONFLICT (keys) DO NOTHING, UPDATE or SELECT.

    A row with a NULL key conflicts with nothing. ``nothing``: of source rows with one key
    the first in order of all columns is inserted. ``update`` (expressions over t.* and
    s.*, s being EXCLUDED) and ``select``: two source rows with one key are an error. A
    row that fails ``where`` stays as it is and isn't returned.
    """
    cols = target.columns
    source = source.select(*(F.col(c).cast(target.schema[c].dataType).alias(c) for c in cols))
    loose, bound = source.filter(~_set(keys)), source.filter(_set(keys))
    each = bound.groupBy(*keys).agg(F.min(F.struct(*cols)).alias("s"), F.count("*").alias("n"))
    if action == "nothing":
        new = each.select("s.*").join(target.select(keys), keys, "left_anti").select(cols).unionByName(loose)
        return target.unionByName(new), new.select(_none(target).alias("old"), F.struct(*cols).alias("new"))
    twice = F.raise_error(F.lit(f"ON CONFLICT DO {action.upper()} command cannot affect row a second time")).cast("boolean")
    once = each.filter(F.when(F.col("n") > 1, twice).otherwise(F.lit(True))).select("s").unionByName(loose.select(F.struct(*cols).alias("s")))
    t = target.select(F.struct(*cols).alias("t"), *(F.col(k).alias(f"__t_{k}") for k in keys))
    s = once.select("s", *(F.col(f"s.{k}").alias(f"__s_{k}") for k in keys))
    both = t.join(s, _equal(keys, "__t_", "__s_"), "full")
    met = F.col("t").isNotNull() & F.col("s").isNotNull()
    acts = met if where is None else met & F.coalesce(where, F.lit(False))
    changed = F.struct(*((update or {}).get(c, F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c) for c in cols)) if action == "update" else F.col("t")
    both = both.select("t", F.when(acts, changed).when(F.col("t").isNotNull(), F.col("t")).otherwise(F.col("s")).alias("new"), (acts | F.col("t").isNull()).alias("told"))
    return both.select("new.*"), both.filter("told").select(F.col("t").alias("old"), "new")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: dict[str, Column] | None = None) -> DataFrame:
    """The table after ``on_conflict``: DO NOTHING, or DO UPDATE where expressions are given."""
    return on_conflict(target, source, keys, "nothing" if update is None else "update", update)[0]


def update_returning(target: DataFrame, source: DataFrame, keys: list[str], values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """UPDATE t SET ... FROM s WHERE equal keys, with expressions over t.* and s.*.

    Of several source rows for a key the first in order of all columns counts, so a
    target row stays one. NULL keys meet nothing.
    """
    one = source.filter(_set(keys)).groupBy(*keys).agg(F.min(F.struct(*source.columns)).alias("s")).select("s", *(F.col(k).alias(f"__s_{k}") for k in keys))
    t = target.select(F.struct(*target.columns).alias("t"), *(F.col(k).alias(f"__t_{k}") for k in keys))
    got = t.join(one, _equal(keys, "__t_", "__s_"), "left")
    made = F.struct(*((values[c] if c in values else F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c) for c in target.columns))
    both = got.select("t", F.when(F.col("s").isNotNull(), made).alias("new"))
    return both.select(F.coalesce("new", "t").alias("r")).select("r.*"), both.filter("new IS NOT NULL").select(F.col("t").alias("old"), "new")


def update_from(target: DataFrame, source: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """The table after ``update_returning``."""
    return update_returning(target, source, keys, values)[0]


def delete_returning(target: DataFrame, source: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """DELETE FROM t USING s WHERE equal keys."""
    gone = target.join(source.select(keys), keys, "left_semi").select(target.columns)
    return target.join(source.select(keys), keys, "left_anti").select(target.columns), gone.select(F.struct(*target.columns).alias("old"), _none(target).alias("new"))


def truncate(target: DataFrame) -> DataFrame:
    """The table without rows."""
    return target.limit(0)


def update_where(target: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return target.withColumns({c: F.when(F.coalesce(condition, F.lit(False)), v).otherwise(F.col(c)).cast(target.schema[c].dataType) for c, v in values.items()})


def delete_using(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(source, keys, "left_anti")


def unique_violations(df: DataFrame, keys: list[str], nulls_distinct: bool = True) -> DataFrame:
    """Keys that occur more than once, with their number."""
    rows = df
    if nulls_distinct:
        for k in keys:
            rows = rows.filter(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def fk_violations(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Child rows without a parent; rows with a NULL key are in order (MATCH SIMPLE)."""
    rows = child
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    p = parent.select(*(F.col(v).alias(f"__{v}") for v in keys.values())).distinct()
    on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"__{v}") for k, v in keys.items()))
    return rows.join(p, on, "left_anti")


def fk_cascade(child: DataFrame, deleted: DataFrame, keys: dict[str, str], action: str = "cascade") -> DataFrame:
    """The child table after parent rows went: cascade drops rows, set null clears their keys, restrict is an error."""
    p = deleted.select(*(F.col(v).alias(f"__{v}") for v in keys.values())).distinct()
    on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"__{v}") for k, v in keys.items()))
    if action == "cascade":
        return child.join(p, on, "left_anti")
    hit = F.col(f"__{next(iter(keys.values()))}").isNotNull()
    got = child.join(p, on, "left")
    if action == "set null":
        return got.select(*(F.when(~hit, F.col(c)).alias(c) if c in keys else F.col(c) for c in child.columns))
    return got.filter(F.when(hit, F.raise_error(F.lit("update or delete violates foreign key constraint")).cast("boolean")).otherwise(F.lit(True))).select(child.columns)


def check(df: DataFrame, condition: Column, message: str = "violates check constraint") -> DataFrame:
    """The table; a row for which the condition is false is an error (NULL passes)."""
    wrong = ~F.coalesce(condition, F.lit(True))
    return df.filter(F.when(wrong, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = check(df, F.col(c).isNotNull(), f"null value in column {c!r} violates not-null constraint")
    return df


def overlap_violations(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """WITHOUT OVERLAPS: rows whose range [low, high) begins before one of the same key ended. A window, not a self join."""
    w = Window.partitionBy(*keys).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__end", F.max(high).over(w)).filter(F.col(low) < F.col("__end")).drop("__end")


def generated(df: DataFrame, **columns: Column) -> DataFrame:
    """Generated columns."""
    return df.withColumns(columns)


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changes from one state of a table to another: (op, old struct, new struct), op INSERT, UPDATE or DELETE."""
    cols = old.columns
    o = old.select(F.struct(*cols).alias("old"), *(F.col(k).alias(f"__o_{k}") for k in keys))
    n = new.select(F.struct(*cols).alias("new"), *(F.col(k).alias(f"__n_{k}") for k in keys))
    on = reduce(lambda a, b: a & b, (F.col(f"__o_{k}") == F.col(f"__n_{k}") for k in keys))
    both = o.join(n, on, "full")
    op = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").when(~F.col("old").eqNullSafe(F.col("new")), "UPDATE")
    return both.select(op.alias("op"), "old", "new").filter(F.col("op").isNotNull())


def partition_of(df: DataFrame, column: str, bounds: list, name: str = "part") -> DataFrame:
    """RANGE partitioning: the number of bounds that are not above the value; NULL goes to the default, -1."""
    c = F.col(column)
    number = reduce(lambda a, b: a + b, ((c >= F.lit(b)).cast("int") for b in bounds))
    return df.withColumn(name, F.coalesce(number, F.lit(-1)))


def list_partition_of(df: DataFrame, column: str, lists: dict[str, list], name: str = "part", default: str = "default") -> DataFrame:
    """LIST partitioning by value, with a default."""
    out = F.lit(default)
    for part, held in lists.items():
        out = F.when(F.col(column).isin(*held), F.lit(part)).otherwise(out)
    return df.withColumn(name, out)


def hash_partition_of(df: DataFrame, columns: list[str], modulus: int, name: str = "part") -> DataFrame:
    """HASH partitioning; the hash is Spark's."""
    return df.withColumn(name, F.pmod(F.xxhash64(*columns), F.lit(modulus)).cast("int"))


def check_violations(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a CHECK condition is false (NULL passes)."""
    return df.filter(~F.coalesce(condition, F.lit(True)))


def period_violations(child: DataFrame, parent: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """FOREIGN KEY (keys, PERIOD [low, high)): child rows whose range the parent's ranges of the same keys don't cover.

    The parent's ranges are joined to islands first; one island must hold a child's range.
    """
    from sparrel.operators.aggregate import range_agg

    islands = range_agg(parent, keys, low, high).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(low).alias("__low"), F.col(high).alias("__high"))
    return child.join(islands, _equal(keys, "", "__") & (F.col("__low") <= F.col(low)) & (F.col(high) <= F.col("__high")), "left_anti")


def analyze(df: DataFrame, columns: list[str], most_common: int = 10, bounds: int = 10) -> DataFrame:
    """Statistics of columns, values as text: (column_name, null_frac, n_distinct, most_common_vals, most_common_freqs, lo, hi, histogram_bounds).

    One pass of partial aggregation over (column, value) for all columns, stored. The
    most common values of a column are taken by each task and put together, so no task
    sorts a column. The histogram of a number or time has ``bounds`` + 1 values that
    split the rows about evenly; other columns have none.
    """
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns))).alias("z")).select("z.*")
    counts = settle(cells.groupBy("column_name", "v").agg(F.count("*").alias("n")), "value-counts")
    known = counts.filter(F.col("v").isNotNull())
    tops = reduce(DataFrame.unionByName, (known.filter(F.col("column_name") == c).orderBy(F.desc("n"), "v").limit(most_common) for c in columns))
    top = tops.groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "v"))).alias("top"))
    whole = counts.groupBy("column_name").agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.sum("n").alias("total"), F.count("v").alias("n_distinct"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    total, held = F.col("total"), F.coalesce("top", F.array().cast("array<struct<n: bigint, v: string>>"))
    told = whole.join(F.broadcast(top), "column_name", "left").select(
        "column_name", (F.col("nulls") / total).alias("null_frac"), "n_distinct", F.transform(held, lambda s: s["v"]).alias("most_common_vals"), F.transform(held, lambda s: -s["n"] / total).alias("most_common_freqs"), "lo", "hi"
    )
    numeric = [c for c in columns if not _texts(df, c)]
    if not numeric:
        return told.withColumn("histogram_bounds", F.lit(None).cast("array<string>"))
    steps = [k / bounds for k in range(bounds + 1)]
    wide = df.agg(*(F.transform(F.percentile_approx(c, steps, 10_000), lambda v: v.cast("string")).alias(c) for c in numeric))
    split = wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("histogram_bounds")) for c in numeric))).alias("z")).select("z.*")
    return told.join(F.broadcast(split), "column_name", "left")


def _texts(df: DataFrame, column: str) -> bool:
    return not isinstance(df.schema[column].dataType, (NumericType, DateType, TimestampType, TimestampNTZType))


def dependencies(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Extended statistics of pairs of columns: (a, b, ndistinct, degree). ``degree``: the share of rows in which a value of a has one value of b only."""
    out = []
    for a, b in pairs:
        both = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
        by_a = both.groupBy("a").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
        one = by_a.agg(F.sum("kinds").alias("ndistinct"), (F.sum(F.when(F.col("kinds") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("degree"))
        out.append(one.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "ndistinct", "degree"))
    return reduce(DataFrame.unionByName, out)
