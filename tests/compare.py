"""Compares a query's rows with those of SQL in DuckDB, in no order, by column name."""

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir):
    import os

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, Decimal):
        return float(f"{float(x):.9g}")
    if isinstance(x, datetime):
        return x.isoformat(sep=" ")
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, (list, tuple)) and not hasattr(x, "asDict"):
        return tuple(map(value, x))
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


def spark_rows(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, text):
    rel = con.sql(text)
    return table(rel.columns, rel.fetchall())
