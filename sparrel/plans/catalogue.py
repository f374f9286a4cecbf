"""The registry of queries: a name, a plan over a folder of tables, and SQL for DuckDB with the same result."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sparrel.session import sql
from sparrel.shipping import ship

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, plan: Plan) -> None:
    if name in PLANS:
        raise ValueError(f"query {name} is there already")
    PLANS[name] = plan


def query(oracle: str | None = None):
    """Register a function as a query under its own name."""

    def add(fn: Plan) -> Plan:
        @wraps(fn)
        def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        _add(fn.__name__, plan)
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def same(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query in SQL. ``{table}`` stands for a table; ``oracle`` is the SQL for DuckDB where it differs."""
    _add(name, lambda spark, sf_dir: sql(spark, sf_dir, text))
    ORACLES[name] = oracle or text.replace("{", "").replace("}", "")
