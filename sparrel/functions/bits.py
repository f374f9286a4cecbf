"""Bit strings, as text of 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zip(a: Column, b: Column, fn) -> Column:
    same = F.length(a) == F.length(b)
    bits = F.zip_with(F.split(a, ""), F.split(b, ""), fn)
    return F.when(same, F.concat_ws("", bits)).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("cannot combine bit strings of different sizes")).cast("string"))


def bit_and(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: F.when((x == "1") & (y == "1"), "1").otherwise("0"))


def bit_or(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: F.when((x == "1") | (y == "1"), "1").otherwise("0"))


def bit_xor(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: F.when(x != y, "1").otherwise("0"))


def bit_not(a: Column) -> Column:
    return F.translate(a, "01", "10")


def shift_left(a: Column, n: int) -> Column:
    """Shift and fill with 0; a negative n shifts right."""
    if n < 0:
        return shift_right(a, -n)
    return F.rpad(F.substr(a, F.lit(n + 1)), F.length(a), F.lit("0"))


def shift_right(a: Column, n: int) -> Column:
    if n < 0:
        return shift_left(a, -n)
    return F.lpad(F.left(a, F.greatest(F.length(a) - n, F.lit(0))), F.length(a), F.lit("0"))


def bit_count(a: Column) -> Column:
    return F.length(F.translate(a, "0", "")).cast("bigint")


def get_bit(a: Column, n: int) -> Column:
    """Bit n, counted from 0 at the left; outside is an error."""
    return F.when(F.length(a) > n, F.substr(a, F.lit(n + 1), F.lit(1)).cast("int")).when(a.isNotNull(), F.raise_error(F.lit(f"bit index {n} out of valid range")).cast("int"))


def set_bit(a: Column, n: int, value: int) -> Column:
    return F.concat(F.left(a, F.lit(n)), F.lit(str(value)), F.substr(a, F.lit(n + 2)))
