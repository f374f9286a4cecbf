"""Views, materialized views, domains, row policies, sequences, user-defined operators, and what the session's catalog holds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrel.stored import settle


def create_view(df: DataFrame, name: str, replace: bool = True) -> None:
    """A view of the session: expanded where it is used."""
    (df.createOrReplaceTempView if replace else df.createTempView)(name)


def create_materialized_view(df: DataFrame, name: str, with_data: bool = True) -> None:
    """A table with a query's rows."""
    (df if with_data else df.limit(0)).write.saveAsTable(name)


def refresh_materialized_view(df: DataFrame, name: str) -> None:
    """Replace the rows of a materialized view; the query must not read the view itself."""
    df.write.mode("overwrite").saveAsTable(name)


@dataclass
class Domain:
    """A type with checks: a base type, NOT NULL, and conditions over a value."""

    base: str
    not_null: bool = False
    checks: list[Callable[[Column], Column]] = field(default_factory=list)

    def __call__(self, x: Column) -> Column:
        """The value in the domain; a value outside is an error. A condition that is NULL passes."""
        value = x.cast(self.base)
        wrong = F.lit(False)
        for check in self.checks:
            wrong = wrong | ~F.coalesce(check(value), F.lit(True))
        if self.not_null:
            wrong = wrong | value.isNull()
        return F.when(wrong, F.raise_error(F.lit("value for domain violates check constraint")).cast(self.base)).otherwise(value)


@dataclass
class Policy:
    """A row policy: which rows a role sees, and which new rows it may write."""

    roles: set[str]
    using: Column
    with_check: Column | None = None
    permissive: bool = True


def visible(df: DataFrame, role: str, policies: list[Policy]) -> DataFrame:
    """Rows that a role sees: any permissive policy, and all restrictive ones. Without a permissive policy, none."""
    own = [p for p in policies if role in p.roles or "public" in p.roles]
    some = F.lit(False)
    for p in own:
        if p.permissive:
            some = some | F.coalesce(p.using, F.lit(False))
    for p in own:
        if not p.permissive:
            some = some & F.coalesce(p.using, F.lit(False))
    return df.filter(some)


def checked(df: DataFrame, role: str, policies: list[Policy]) -> DataFrame:
    """New rows of a role; a row that no policy admits is an error."""
    some = F.lit(False)
    for p in policies:
        if p.permissive and (role in p.roles or "public" in p.roles):
            some = some | F.coalesce(p.using if p.with_check is None else p.with_check, F.lit(False))
    return df.filter(F.when(~some, F.raise_error(F.lit("new row violates row-level security policy")).cast("boolean")).otherwise(F.lit(True)))


def with_serial(df: DataFrame, name: str, order: list[Column], start: int = 1, step: int = 1) -> DataFrame:
    """A dense serial number in the given order, by ranges: partitions are counted, then numbered within.

    No global window: only the number of rows of each partition goes to the driver.
    Rows that tie in the order get their numbers in no definite order.
    """
    ranged = settle(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "serial")  # bounds are sampled anew in each run
    sizes = {r["__p"]: r["n"] for r in ranged.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    base = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("__p")), F.lit(0)) if before else F.lit(0)
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.withColumn(name, (F.lit(start) + (base + inside - 1) * step).cast("bigint")).drop("__p")


class Sequence:
    """nextval, currval and setval of a sequence that a driver holds."""

    def __init__(self, start: int = 1, step: int = 1, least: int | None = None, most: int | None = None, cycle: bool = False):
        self.step, self.cycle = step, cycle
        self.least = least if least is not None else (1 if step > 0 else -(1 << 63))
        self.most = most if most is not None else ((1 << 63) - 1 if step > 0 else -1)
        self.start, self.last, self.called = start, start, False

    def nextval(self) -> int:
        value = self.last + self.step if self.called else self.last
        if not self.least <= value <= self.most:
            if not self.cycle:
                raise OverflowError("sequence reached its limit")
            value = self.least if self.step > 0 else self.most
        self.last, self.called = value, True
        return value

    def currval(self) -> int:
        if not self.called:
            raise LookupError("currval of the sequence is not yet defined")
        return self.last

    def setval(self, value: int, called: bool = True) -> int:
        self.last, self.called = value, called
        return value


#: CREATE OPERATOR: symbols and functions of Columns.
OPERATORS: dict[str, Callable[..., Column]] = {}


def equal(a: Column, b: Column) -> Column:
    """booleq, int4eq, texteq and the like, as functions."""
    return a == b


OPERATORS |= {name: equal for name in ("booleq", "int4eq", "texteq")}


def create_operator(symbol: str, fn: Callable[..., Column]) -> None:
    OPERATORS[symbol] = fn


def apply_operator(symbol: str, *args: Column) -> Column:
    if symbol not in OPERATORS:
        raise LookupError(f"operator does not exist: {symbol}")
    return OPERATORS[symbol](*args)


def information_tables(spark: SparkSession) -> DataFrame:
    """information_schema.tables: (table_schema, table_name, table_type)."""
    rows = [((t.namespace or [""])[-1] if t.namespace else "", t.name, "VIEW" if t.tableType in ("VIEW", "TEMPORARY") else "BASE TABLE") for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")


def information_columns(spark: SparkSession, *tables: str) -> DataFrame:
    """information_schema.columns: (table_name, column_name, ordinal_position, data_type, is_nullable)."""
    rows = [(t, c.name, k, c.dataType, "YES" if c.nullable else "NO") for t in tables for k, c in enumerate(spark.catalog.listColumns(t), 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")


#: Names of types as pg_typeof() gives them: fixed values.
TYPE_NAMES = {"smallint": "smallint", "int": "integer", "bigint": "bigint", "float": "real", "double": "double precision", "boolean": "boolean", "string": "text", "binary": "bytea", "date": "date", "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp without time zone"}


def type_name(x: Column) -> Column:
    """pg_typeof()."""
    kind = F.typeof(x)
    out = F.when(F.startswith(kind, F.lit("decimal")), F.lit("numeric"))
    for k, v in TYPE_NAMES.items():
        out = out.when(kind == k, F.lit(v))
    return out.otherwise(kind)


def input_is_valid(x: Column, kind: str) -> Column:
    """pg_input_is_valid()."""
    return F.when(x.isNotNull(), x.try_cast(kind).isNotNull())


def input_error(x: Column, kind: str) -> Column:
    """pg_input_error_info(): struct (message, detail, hint, sql_error_code), with NULLs for valid input."""
    name = TYPE_NAMES.get(kind, kind)
    number = x.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    whole = kind in ("smallint", "int", "bigint")
    beyond = x.rlike(r"^\s*[+-]?\d+\s*$") if whole else number & F.lit(kind in ("float", "double"))
    bad = x.isNotNull() & ~input_is_valid(x, kind)
    message = F.when(beyond, F.concat(F.lit('value "'), x, F.lit(f'" is out of range for type {name}'))).otherwise(F.concat(F.lit(f'invalid input syntax for type {name}: "'), x, F.lit('"')))
    none = F.lit(None).cast("string")
    return F.struct(F.when(bad, message).alias("message"), none.alias("detail"), none.alias("hint"), F.when(bad, F.when(beyond, "22003").otherwise("22P02")).alias("sql_error_code"))


def size_pretty(n: Column) -> Column:
    """pg_size_pretty(): bytes up to 10 times a unit, rounded."""
    out = F.when(F.abs(n) < 10 * 1024, F.concat(n.cast("string"), F.lit(" bytes")))
    for k, unit in enumerate(("kB", "MB", "GB", "TB", "PB"), 1):
        scaled = F.round(n / F.lit(float(1024**k)), 0).cast("bigint")
        fits = F.abs(n) < 10 * 1024 ** (k + 1) if k < 5 else F.lit(True)
        out = out.when(fits, F.concat(scaled.cast("string"), F.lit(f" {unit}")))
    return out
