"""Arrays: counted from 1, NULL outside, NULL instead of 0 for empty ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subscript(a: Column, n: Column | int) -> Column:
    return F.get(a, (n if isinstance(n, Column) else F.lit(n)) - 1)


def slice_(a: Column, low: int, high: int) -> Column:
    """a[low:high]; empty if nothing is inside."""
    low = max(low, 1)
    return F.slice(a, low, max(high - low + 1, 0))


def array_length(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.size(a))


array_upper = array_length


def array_lower(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.lit(1))


def array_dims(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.concat(F.lit("[1:"), F.size(a).cast("string"), F.lit("]")))


def array_to_string(a: Column, separator: str, null: str | None = None) -> Column:
    return F.array_join(a, separator) if null is None else F.array_join(a, separator, null)


def string_to_array(s: Column, separator: str | None, null: str | None = None) -> Column:
    """Parts of a text; an empty text has none. Without a separator, its characters. ``null``: the part that is NULL."""
    import re

    parts = F.split(s, "" if separator is None else re.escape(separator))
    if null is not None:
        parts = F.transform(parts, lambda p: F.when(p != null, p))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(parts)
