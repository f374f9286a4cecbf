"""Plain jsonpaths as built-in expressions over variants, without Python.

Plain are, in lax mode: members, numbered and all elements, and one filter that
compares a path with a number or a string. ``columns`` gives None for other paths,
which ``jsonpath`` evaluates.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = r"""\.\s*(?:[A-Za-z_]\w*(?!\s*\()|"[^"\\]*")|\[\s*(?:\d+|\*)\s*\]"""
_CONSTANT = r"""-?\d+(?:\.\d+)?|"[^"\\]*\""""
_COMPARE = rf"@(?P<inner>(?:{_STEP})*)\s*(?P<op>==|!=|<>|<=|>=|<|>)\s*(?P<value>{_CONSTANT})"
_PATH = re.compile(rf"\s*(?:lax\s+)?\$(?P<steps>(?:{_STEP})*)\s*(?:\?\s*\(\s*{_COMPARE}\s*\))?\s*\Z")
_MATCH = re.compile(rf"\s*(?:lax\s+)?\$(?P<steps>(?:{_STEP})*)\s*(?P<op>==|!=|<>|<=|>=|<|>)\s*(?P<value>{_CONSTANT})\s*\Z")
_ONE = re.compile(_STEP)
_OPS = {"==": "__eq__", "!=": "__ne__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
_NUMBERS = r"^(BIGINT|DOUBLE|DECIMAL|FLOAT)"


@dataclass
class Plain:
    """A plain path: its steps, and the filter or comparison (inner steps, operator, constant), if any."""

    steps: list[str]
    test: tuple[list[str], str, object] | None

    def items(self, j: Column) -> Column:
        """The path's items in a JSON text, as array<variant>; NULL for NULL."""
        out = _follow(F.array(F.parse_json(j)), self.steps)
        if self.test is not None:
            inner, op, value = self.test
            out = F.filter(_elements(out), lambda v: F.exists(_elements(_follow(F.array(v), inner)), lambda x: F.coalesce(_compare(x, op, value), F.lit(False))))
        return F.when(j.isNotNull(), out)


def _steps(text: str) -> list[str]:
    return [m[0].lstrip(". ").strip() for m in _ONE.finditer(text)]


def columns(path: str) -> Plain | None:
    m = _PATH.match(path)
    if not m:
        return None
    return Plain(_steps(m["steps"]), (_steps(m["inner"] or ""), m["op"], json.loads(m["value"])) if m["op"] else None)


def comparison(path: str) -> tuple[Plain, str, object] | None:
    """A path that is one comparison of a plain path with a constant."""
    m = _MATCH.match(path)
    return (Plain(_steps(m["steps"]), None), m["op"], json.loads(m["value"])) if m else None


def _is_array(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def _held(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _elements(items: Column) -> Column:
    """Arrays among the items give way to their elements."""
    return F.flatten(F.transform(items, lambda v: F.when(_is_array(v), _held(v)).otherwise(F.array(v))))


def _numbered(k: int):
    """Element k of an array; anything else is an array of itself."""
    return lambda v: F.when(_is_array(v), F.try_variant_get(v, f"$[{k}]", "variant")).otherwise(v if k == 0 else F.lit(None).cast("variant"))


def _member(name: str):
    return lambda v: F.try_variant_get(v, f"$['{name}']", "variant")


def _follow(items: Column, steps: list[str]) -> Column:
    for step in steps:
        if step.startswith("["):
            k = step.strip("[] ")
            if k == "*":
                items = _elements(items)
                continue
            items = F.transform(items, _numbered(int(k)))
        else:
            items = F.transform(_elements(items), _member(step.strip('"').replace("'", "\\'")))
        items = F.filter(items, lambda v: v.isNotNull())
    return items


def _compare(v: Column, op: str, value: object) -> Column:
    """NULL where the types can't be compared; null is unequal to everything."""
    kind = F.schema_of_variant(v)
    if isinstance(value, str):
        fits, got = kind == "STRING", F.try_variant_get(v, "$", "string")
    elif isinstance(value, int):
        fits, got = kind.rlike(_NUMBERS), F.when(kind == "BIGINT", getattr(F.try_variant_get(v, "$", "bigint"), _OPS[op])(F.lit(value))).otherwise(getattr(F.try_variant_get(v, "$", "double"), _OPS[op])(F.lit(value)))
        return F.when(fits, got).when(kind == "VOID", F.lit(op in ("!=", "<>")))
    else:
        fits, got = kind.rlike(_NUMBERS), F.try_variant_get(v, "$", "double")
    return F.when(fits, getattr(got, _OPS[op])(F.lit(value))).when(kind == "VOID", F.lit(op in ("!=", "<>")))
