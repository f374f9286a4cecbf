"""Dates and times. An interval is a struct (months, days, micros), since its parts do not mix."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000
MONTH_DAYS = 30


def interval(months: Column | int = 0, days: Column | int = 0, micros: Column | int = 0) -> Column:
    one = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
    return F.struct(one(months, "int").alias("months"), one(days, "int").alias("days"), one(micros, "bigint").alias("micros"))


def date_minus(a: Column, b: Column) -> Column:
    """date - date: days."""
    return F.datediff(a, b)


def micros_of(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def add(t: Column, i: Column) -> Column:
    """timestamp + interval: months, then days, then time."""
    moved = F.add_months(t.cast("date"), i["months"])
    clock = micros_of(t) - micros_of(t.cast("date"))
    return F.timestamp_micros(micros_of(F.date_add(moved, i["days"])) + clock + i["micros"]).cast("timestamp_ntz")


def age(a: Column, b: Column) -> Column:
    """a - b in whole months, days and time, as counted by the calendar."""
    late, early = F.greatest(a, b), F.least(a, b)
    sign = F.when(a >= b, F.lit(1)).otherwise(F.lit(-1))
    whole = (F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early)
    clock = lambda t: micros_of(t) - micros_of(t.cast("date"))
    behind = (F.dayofmonth(early) * F.lit(DAY) + clock(early)) > (F.dayofmonth(late) * F.lit(DAY) + clock(late))
    months = whole - behind.cast("int")
    short = clock(late) < clock(early)
    length = F.dayofmonth(F.last_day(early))  # days of the month that begins the rest
    days = F.dayofmonth(late) - F.dayofmonth(early) - short.cast("int")
    days = F.when(days < 0, days + length).otherwise(days)
    micros = clock(late) - clock(early) + F.when(short, F.lit(DAY)).otherwise(F.lit(0))
    return interval(sign * months, sign * days, sign * micros)


def justify_hours(i: Column) -> Column:
    days = F.call_function("div", i["micros"], F.lit(DAY))
    return interval(i["months"], i["days"] + days, i["micros"] - days * DAY)


def justify_days(i: Column) -> Column:
    months = F.call_function("div", i["days"], F.lit(MONTH_DAYS)).cast("int")
    return interval(i["months"] + months, i["days"] - months * MONTH_DAYS, i["micros"])


def justify_interval(i: Column) -> Column:
    """Whole days and months, and all parts with one sign."""
    total = (i["months"].cast("bigint") * MONTH_DAYS + i["days"]) * DAY + i["micros"]
    sign = F.signum(total.cast("double")).cast("bigint")
    size = F.abs(total)
    days = F.call_function("div", size, F.lit(DAY))
    months = F.call_function("div", days, F.lit(MONTH_DAYS))
    return interval(sign * months, sign * (days - months * MONTH_DAYS), sign * (size - days * DAY))


def dow(t: Column) -> Column:
    """Day of the week, 0 for Sunday."""
    return F.dayofweek(t) - 1


#: Template patterns for dates and times and what Spark calls them, longest first: fixed values.
PATTERNS = {"YYYY": "yyyy", "HH24": "HH", "HH12": "hh", "Month": "MMMM", "DDD": "DDD", "Mon": "MMM", "Day": "EEEE", "YY": "yy", "MM": "MM", "DD": "dd", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "Dy": "E", "AM": "a", "PM": "a", "Q": "Q"}


def spark_pattern(template: str) -> str:
    """A date and time template in Spark's letters; other letters stand for themselves."""
    keys = sorted(PATTERNS, key=len, reverse=True)
    out = []
    for m in re.finditer("|".join(keys) + r'|"[^"]*"|[A-Za-z]+|[^A-Za-z"]+', template):
        part = m[0]
        out.append(PATTERNS.get(part) or (f"'{part.strip(chr(34))}'" if part[0].isalpha() or part[0] == '"' else part))
    return "".join(out)


def to_char(t: Column, template: str) -> Column:
    return F.date_format(t, spark_pattern(template))


def to_date(s: Column, template: str) -> Column:
    return F.to_date(s, spark_pattern(template))


def to_timestamp(s: Column, template: str) -> Column:
    return F.to_timestamp_ntz(s, F.lit(spark_pattern(template)))


def at_time_zone(t: Column, zone: str, from_zone: str = "UTC") -> Column:
    return F.convert_timezone(F.lit(from_zone), F.lit(zone), t)
