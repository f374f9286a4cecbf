"""Ranges as structs (lo, hi, lo_inc, hi_inc, empty) and multiranges as arrays of them.

A NULL bound is infinite. Ranges of integers and dates are kept as [lo, hi).
All functions are Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _make(lo: Column, hi: Column, lo_inc: Column, hi_inc: Column, empty: Column) -> Column:
    gone = lambda c: F.when(~empty, c)
    return F.struct(
        gone(lo).alias("lo"), gone(hi).alias("hi"), (~empty & lo_inc & lo.isNotNull()).alias("lo_inc"), (~empty & hi_inc & hi.isNotNull()).alias("hi_inc"), empty.alias("empty")
    )


def _or_fail(wrong: Column, empty: Column) -> Column:
    return F.when(wrong, F.raise_error(F.lit("range lower bound must be less than or equal to range upper bound")).cast("boolean")).otherwise(empty)


def range_(lo: Column, hi: Column, bounds: str = "[)") -> Column:
    """A range of a continuous type; lo above hi is an error."""
    li, hi_inc = F.lit(bounds[0] == "["), F.lit(bounds[1] == "]")
    wrong = F.coalesce(lo > hi, F.lit(False))
    empty = _or_fail(wrong, F.coalesce((lo == hi) & ~(li & hi_inc), F.lit(False)))
    return _make(lo, hi, li, hi_inc, empty)


def discrete(lo: Column, hi: Column, bounds: str = "[)", step=lambda x: x + 1) -> Column:
    """A range of integers (or, with another step, dates): made [lo, hi)."""
    a = lo if bounds[0] == "[" else step(lo)
    b = step(hi) if bounds[1] == "]" else hi
    wrong = F.coalesce(lo > hi, F.lit(False))
    return _make(a, b, F.lit(True), F.lit(False), _or_fail(wrong, F.coalesce(a >= b, F.lit(False))))


def date_range(lo: Column, hi: Column, bounds: str = "[)") -> Column:
    return discrete(lo, hi, bounds, lambda d: F.date_add(d, 1))


def contains(r: Column, x: Column) -> Column:
    """range @> element."""
    above = r["lo"].isNull() | (x > r["lo"]) | ((x == r["lo"]) & r["lo_inc"])
    below = r["hi"].isNull() | (x < r["hi"]) | ((x == r["hi"]) & r["hi_inc"])
    return ~r["empty"] & above & below


def _lo_le(a: Column, b: Column) -> Column:
    """Whether a's lower bound is not above b's."""
    return a["lo"].isNull() | (b["lo"].isNotNull() & ((a["lo"] < b["lo"]) | ((a["lo"] == b["lo"]) & (a["lo_inc"] | ~b["lo_inc"]))))


def _hi_ge(a: Column, b: Column) -> Column:
    """Whether a's upper bound is not below b's."""
    return a["hi"].isNull() | (b["hi"].isNotNull() & ((a["hi"] > b["hi"]) | ((a["hi"] == b["hi"]) & (a["hi_inc"] | ~b["hi_inc"]))))


def contains_range(a: Column, b: Column) -> Column:
    return b["empty"] | (~a["empty"] & F.coalesce(_lo_le(a, b) & _hi_ge(a, b), F.lit(False)))


def before(a: Column, b: Column) -> Column:
    """a << b: all of a lies before all of b."""
    return ~a["empty"] & ~b["empty"] & F.coalesce((a["hi"] < b["lo"]) | ((a["hi"] == b["lo"]) & ~(a["hi_inc"] & b["lo_inc"])), F.lit(False))


def after(a: Column, b: Column) -> Column:
    return before(b, a)


def overlaps(a: Column, b: Column) -> Column:
    """a && b."""
    return ~a["empty"] & ~b["empty"] & ~before(a, b) & ~before(b, a)


def not_right_of(a: Column, b: Column) -> Column:
    """a &< b: a does not extend above b."""
    return ~a["empty"] & ~b["empty"] & F.coalesce(_hi_ge(b, a), F.lit(False))


def not_left_of(a: Column, b: Column) -> Column:
    """a &> b: a does not extend below b."""
    return ~a["empty"] & ~b["empty"] & F.coalesce(_lo_le(b, a), F.lit(False))


def adjacent(a: Column, b: Column) -> Column:
    touch = lambda x, y: F.coalesce((x["hi"] == y["lo"]) & (x["hi_inc"] != y["lo_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (touch(a, b) | touch(b, a))


def intersect(a: Column, b: Column) -> Column:
    la, ha = _lo_le(a, b), _hi_ge(a, b)
    lo, li = F.when(la, b["lo"]).otherwise(a["lo"]), F.when(la, b["lo_inc"]).otherwise(a["lo_inc"])
    hi, hinc = F.when(ha, b["hi"]).otherwise(a["hi"]), F.when(ha, b["hi_inc"]).otherwise(a["hi_inc"])
    return F.when(overlaps(a, b), _make(lo, hi, li, hinc, F.lit(False))).when(a.isNotNull() & b.isNotNull(), _make(a["lo"], a["hi"], F.lit(False), F.lit(False), F.lit(True)))


def merge(a: Column, b: Column) -> Column:
    """range_merge: the smallest range that holds both."""
    la, ha = _lo_le(a, b), _hi_ge(a, b)
    whole = _make(
        F.when(la, a["lo"]).otherwise(b["lo"]), F.when(ha, a["hi"]).otherwise(b["hi"]), F.when(la, a["lo_inc"]).otherwise(b["lo_inc"]), F.when(ha, a["hi_inc"]).otherwise(b["hi_inc"]), F.lit(False)
    )
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(whole)


def union(a: Column, b: Column) -> Column:
    """a + b; a gap between them is an error."""
    ok = a["empty"] | b["empty"] | overlaps(a, b) | adjacent(a, b)
    return F.when(ok, merge(a, b)).when(a.isNotNull() & b.isNotNull(), _fail(a, "result of range union would not be contiguous"))


def minus(a: Column, b: Column) -> Column:
    """a - b; two parts as the result are an error."""
    apart = ~overlaps(a, b)
    covers_lo, covers_hi = _lo_le(b, a), _hi_ge(b, a)
    left = _make(a["lo"], b["lo"], a["lo_inc"], ~b["lo_inc"], F.lit(False))
    right = _make(b["hi"], a["hi"], ~b["hi_inc"], a["hi_inc"], F.lit(False))
    none = _make(a["lo"], a["hi"], F.lit(False), F.lit(False), F.lit(True))
    return F.when(apart, a).when(covers_lo & covers_hi, none).when(covers_lo, right).when(covers_hi, left).when(a.isNotNull() & b.isNotNull(), _fail(a, "result of range difference would not be contiguous"))


def _fail(like: Column, message: str) -> Column:
    """An error in a place that has the type of ``like``."""
    return F.when(F.raise_error(F.lit(message)).cast("boolean"), like)


def to_text(r: Column) -> Column:
    body = F.concat(
        F.when(r["lo_inc"], "[").otherwise("("), F.coalesce(r["lo"].cast("string"), F.lit("")), F.lit(","), F.coalesce(r["hi"].cast("string"), F.lit("")), F.when(r["hi_inc"], "]").otherwise(")")
    )
    return F.when(r["empty"], F.lit("empty")).otherwise(body)


def sort_key(r: Column) -> Column:
    """A struct that orders ranges: empty ones first, then by lower and upper bound."""
    return F.struct(
        (~r["empty"]).alias("a"), r["lo"].isNotNull().alias("b"), r["lo"].alias("c"), (~r["lo_inc"]).alias("d"), r["hi"].isNull().alias("e"), r["hi"].alias("f"), r["hi_inc"].alias("g")
    )


def normalize(rs: Column) -> Column:
    """A multirange: sorted, joined where ranges overlap or touch, without empty ones."""
    keyed = F.transform(F.filter(rs, lambda r: r.isNotNull() & ~r["empty"]), lambda r: F.struct(sort_key(r).alias("k"), r.alias("r")))
    ordered = F.transform(F.array_sort(keyed), lambda x: x["r"])
    start = F.filter(rs, lambda r: F.lit(False))

    def step(acc: Column, r: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joins = (F.size(acc) > 0) & (overlaps(last, r) | adjacent(last, r))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merge(last, r)))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(ordered, start, step)


def multi_union(a: Column, b: Column) -> Column:
    return normalize(F.concat(a, b))


def multi_intersect(a: Column, b: Column) -> Column:
    return normalize(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: intersect(x, y)))))


def multi_contains(m: Column, x: Column) -> Column:
    return F.exists(m, lambda r: contains(r, x))


def multi_text(m: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(m, to_text), ","), F.lit("}"))


def multi_minus(a: Column, b: Column) -> Column:
    """a - b of multiranges: what of each range no range of b covers."""

    def without(parts: Column, y: Column) -> Column:
        left = lambda x: _make(x["lo"], y["lo"], x["lo_inc"], ~y["lo_inc"], F.lit(False))
        right = lambda x: _make(y["hi"], x["hi"], ~y["hi_inc"], x["hi_inc"], F.lit(False))
        pieces = lambda x: F.when(~overlaps(x, y), F.array(x)).otherwise(F.concat(F.when(_lo_le(y, x), F.array()).otherwise(F.array(left(x))), F.when(_hi_ge(y, x), F.array()).otherwise(F.array(right(x)))))
        return F.flatten(F.transform(parts, pieces))

    return normalize(F.aggregate(normalize(b), normalize(a), without))


def from_text(s: Column, kind: str = "int") -> Column:
    """A range of numbers from its text, as ``to_text`` gives it. Integers are made [lo, hi); other text is an error."""
    pattern = r"^\s*([\[(])\s*([^,\s]*)\s*,\s*([^,\s]*)\s*([\])])\s*$"
    empty = F.lower(F.trim(s)) == "empty"
    part = lambda k: F.regexp_extract(s, pattern, k)
    bound = lambda k: F.when(part(k) != "", part(k).cast(kind))
    li, hi_inc = part(1) == "[", part(4) == "]"
    lo, hi = bound(2), bound(3)
    if kind in ("int", "bigint"):
        lo, hi, li, hi_inc = F.when(li, lo).otherwise(lo + 1), F.when(hi_inc, hi + 1).otherwise(hi), F.lit(True), F.lit(False)
    none = F.coalesce((lo > hi) | ((lo == hi) & ~(li & hi_inc)), F.lit(False)) | empty
    wrong = F.raise_error(F.concat(F.lit("malformed range literal: "), s)).cast("boolean")
    return F.when(F.when(empty | s.rlike(pattern), F.lit(True)).otherwise(wrong), _make(lo, hi, li, hi_inc, none))
