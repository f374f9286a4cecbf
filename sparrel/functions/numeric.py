"""Numbers: where Spark's functions differ from a SQL database's."""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

#: Steps that Euclid's algorithm takes at most for 64-bit integers.
EUCLID_STEPS = 92


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero; division by zero is an error."""
    return F.call_function("div", a, b)


def trunc(x: Column, digits: int = 0) -> Column:
    """Cut off at ``digits`` places, toward zero."""
    scale = F.lit(10.0**digits)
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)).cast("double") / scale


def round_even(x: Column, digits: int = 0) -> Column:
    """Rounding of binary floating point: halves go to the even neighbour."""
    return F.bround(x, digits)


def to_int(x: Column) -> Column:
    """Cast of a double to bigint: rounds, halves to even (Spark's cast cuts off)."""
    return F.bround(x, 0).cast("bigint")


def log_base10(x: Column) -> Column:
    """log(x) with one argument has base 10."""
    return F.log10(x)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor; gcd(0, 0) is 0."""
    start = F.struct(F.abs(a.cast("bigint")).alias("a"), F.abs(b.cast("bigint")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(EUCLID_STEPS)), start, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple; 0 if either is 0."""
    g = gcd(a, b)
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(F.call_function("div", F.abs(a.cast("bigint")), F.when(g == 0, F.lit(1).cast("bigint")).otherwise(g)) * F.abs(b.cast("bigint")))


def factorial(n: Column) -> Column:
    """n! as decimal(38,0), up to 33!; a negative n is an error."""
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(1).cast("decimal(38,0)"), lambda acc, k: (acc * k.cast("decimal(2,0)")).cast("decimal(38,0)"))
    return F.when(n < 0, F.raise_error(F.lit("factorial of a negative number is undefined")).cast("decimal(38,0)")).otherwise(product)


def width_bucket_of(x: Column, thresholds: Column) -> Column:
    """Number of sorted thresholds that are not above x."""
    return F.when(x.isNotNull(), F.size(F.filter(thresholds, lambda t: t <= x)))


def _fraction(x: Column) -> Column:
    return F.regexp_extract(x.cast("string"), r"\.([0-9]*)$", 1)


def scale(x: Column) -> Column:
    """Digits after the point of a decimal."""
    return F.when(x.isNotNull(), F.length(_fraction(x)))


def min_scale(x: Column) -> Column:
    """Digits after the point that are needed."""
    return F.when(x.isNotNull(), F.length(F.rtrim(_fraction(x), F.lit("0"))))


def trim_scale(x: Column) -> Column:
    """Decimal text without needless zeros after the point."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


@pandas_udf(DoubleType())
def erf(x: pd.Series) -> pd.Series:
    return x.map(math.erf, na_action="ignore")


@pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc, na_action="ignore")


@pandas_udf(DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    return x.map(math.lgamma, na_action="ignore")


def bit_string(x: Column, bits: int) -> Column:
    """The last ``bits`` bits of an integer as text of 0 and 1."""
    return F.substring(F.lpad(F.bin(x.cast("bigint")), 64, "0"), 65 - bits, bits)


def float8send(x: Column) -> Column:
    """The IEEE 754 bytes of a double, big-endian, as lower-case hex."""
    return _float8send(x)


@pandas_udf(StringType())
def _float8send(x: pd.Series) -> pd.Series:
    return x.map(lambda v: struct.pack(">d", v).hex(), na_action="ignore")


def float4send(x: Column) -> Column:
    """The IEEE 754 bytes of a float, big-endian, as lower-case hex."""
    return _float4send(x.cast("float"))


@pandas_udf(StringType())
def _float4send(x: pd.Series) -> pd.Series:
    return x.map(lambda v: struct.pack(">f", v).hex(), na_action="ignore")
