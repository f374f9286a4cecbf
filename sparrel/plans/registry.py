"""All registered queries of the relational part."""

from __future__ import annotations

from . import builtins, dialect_queries, modify, objects, relational, scalars, shapes, structured, tables, windows  # noqa: F401
from .catalogue import ORACLES, PLANS, Plan


def queries() -> dict[str, Plan]:
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
