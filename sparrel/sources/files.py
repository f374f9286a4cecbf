"""COPY in and out: text and CSV with the options of the COPY statement."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Stands for a quoted empty field while CSV is read, since an empty field without quotes is NULL.
_EMPTY = "\u0001"
_SLASH = "\u0002"


def _unescape(s: Column) -> Column:
    """Backslash escapes of the text format."""
    s = F.replace(s, F.lit("\\\\"), F.lit(_SLASH))
    for sign, char in (("t", "\t"), ("n", "\n"), ("r", "\r"), ("b", "\b"), ("f", "\f"), ("v", "\v")):
        s = F.replace(s, F.lit("\\" + sign), F.lit(char))
    return F.replace(F.regexp_replace(s, r"\\(.)", "$1"), F.lit(_SLASH), F.lit("\\"))


def _escape(s: Column, delimiter: str) -> Column:
    for char, sign in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        s = F.replace(s, F.lit(char), F.lit(sign))
    return s if delimiter == "\t" else F.replace(s, F.lit(delimiter), F.lit("\\" + delimiter))


def copy_from(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "text", delimiter: str | None = None, null: str | None = None, header: bool = False, quote: str = '"', escape: str | None = None) -> DataFrame:
    """Read a table as COPY FROM does: a row that does not fit the schema is an error."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if fmt == "csv":
        options = {"sep": delimiter or ",", "nullValue": null or "", "emptyValue": _EMPTY, "header": str(header).lower(), "quote": quote, "escape": escape or quote, "mode": "FAILFAST", "multiLine": "false"}
        rows = spark.read.schema(schema).options(**options).csv(path)
        texts = [f.name for f in schema.fields if isinstance(f.dataType, StringType)]
        return rows.withColumns({c: F.when(F.col(c) == _EMPTY, F.lit("")).otherwise(F.col(c)) for c in texts})
    if fmt != "text":
        raise ValueError(f"COPY format {fmt!r} is not known")
    mark, n = re.escape(delimiter or "\t"), len(schema.fields)
    line = F.col("value")
    fields = F.regexp_extract_all(F.concat(line, F.lit(delimiter or "\t")), F.lit(rf"((?:[^\\{mark}]|\\.)*){mark}"), 1)
    wrong = F.raise_error(F.concat(F.lit("COPY: wrong number of columns in line: "), line)).cast("array<string>")
    rows = spark.read.text(path).select(F.when(F.size(fields) == n, fields).otherwise(wrong).alias("f"))
    cell = lambda k: F.when(F.col("f")[k] != ("\\N" if null is None else null), _unescape(F.col("f")[k]))
    return rows.select(*(cell(k).cast(f.dataType).alias(f.name) for k, f in enumerate(schema.fields)))


def copy_to(df: DataFrame, path: str, fmt: str = "text", delimiter: str | None = None, null: str | None = None, header: bool = False, quote: str = '"', escape: str | None = None, mode: str = "errorifexists") -> None:
    """Write a table as COPY TO does."""
    if fmt == "csv":
        options = {"sep": delimiter or ",", "nullValue": null or "", "emptyValue": quote * 2, "header": str(header).lower(), "quote": quote, "escape": escape or quote}
        df.write.mode(mode).options(**options).csv(path)
        return
    if fmt != "text":
        raise ValueError(f"COPY format {fmt!r} is not known")
    mark = delimiter or "\t"
    cells = [F.coalesce(_escape(F.col(c).cast("string"), mark), F.lit("\\N" if null is None else null)) for c in df.columns]
    df.select(reduce(lambda a, b: F.concat(a, F.lit(mark), b), cells).alias("value")).write.mode(mode).text(path)


def values(spark: SparkSession, rows: list[tuple], columns: list[str] | None = None) -> DataFrame:
    """VALUES: columns are named column1, column2, ... unless names are given."""
    if not rows:
        raise ValueError("VALUES needs a row")
    names = columns or [f"column{k + 1}" for k in range(len(rows[0]))]
    return spark.createDataFrame(rows, names)


def create_table_as(df: DataFrame, name: str, with_data: bool = True, if_not_exists: bool = False, partition_by: list[str] | None = None, path: str | None = None) -> None:
    """CREATE TABLE AS. WITH NO DATA keeps the columns only. ``path``: a folder outside of the warehouse."""
    writer = (df if with_data else df.limit(0)).write.mode("ignore" if if_not_exists else "errorifexists")
    writer = writer.option("path", path) if path else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


def inherit(parent: DataFrame, *children: DataFrame) -> DataFrame:
    """Rows of a parent and its children, with the parent's columns."""
    out = parent
    for child in children:
        out = out.unionByName(child.select(parent.columns))
    return out
