"""JSON text: access, containment, builders. jsonpath is in ``jsonpath``."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType


def field_text(j: Column, key: str | int) -> Column:
    """j ->> key."""
    return F.get_json_object(j, f"$[{key}]" if isinstance(key, int) else f"$['{key}']")


def path_text(j: Column, *path: str | int) -> Column:
    """j #>> path."""
    return F.get_json_object(j, "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in path))


def has_key(j: Column, key: str) -> Column:
    """j ? key."""
    return F.array_contains(F.json_object_keys(j), key)


def has_any(j: Column, *keys: str) -> Column:
    return F.arrays_overlap(F.json_object_keys(j), F.array(*map(F.lit, keys)))


def has_all(j: Column, *keys: str) -> Column:
    return F.size(F.array_intersect(F.json_object_keys(j), F.array(*map(F.lit, keys)))) == len(set(keys))


def is_json(s: Column) -> Column:
    return F.when(s.isNotNull(), F.try_parse_json(s).isNotNull())


def typeof(j: Column) -> Column:
    """object, array, string, number, boolean or null."""
    first = F.left(F.ltrim(j), F.lit(1))
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").when(j.isNotNull(), "number")


def _number_equal(a, b) -> bool:
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def _holds(a, b, top: bool = True) -> bool:
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and _holds(a[k], v, False) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(_holds(x, y, False) for x in a) for y in b)
    if isinstance(a, list):
        return top and any(_number_equal(x, b) for x in a if not isinstance(x, (dict, list)))  # an array holds a bare value
    return not isinstance(a, dict) and _number_equal(a, b)


@pandas_udf(BooleanType())
def contains(a: pd.Series, b: pd.Series) -> pd.Series:
    """a @> b."""
    return pd.Series([None if x is None or y is None else _holds(json.loads(x), json.loads(y)) for x, y in zip(a, b, strict=True)])


def canonical_value(v) -> str:
    """JSON in binary form's order: keys by length, then bytes; no blanks but after ':' and ','."""
    if isinstance(v, dict):
        keys = sorted(v, key=lambda k: (len(k.encode()), k.encode()))
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {canonical_value(v[k])}" for k in keys) + "}"
    if isinstance(v, list):
        return "[" + ", ".join(map(canonical_value, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


@pandas_udf(StringType())
def canonical(j: pd.Series) -> pd.Series:
    """Text of jsonb: sorted keys, the last of equal keys stays."""
    return j.map(lambda x: canonical_value(json.loads(x)), na_action="ignore")


def scalar(v: Column) -> Column:
    """JSON_SCALAR: a value as JSON text; NULL gives NULL."""
    held = F.to_json(F.array(v))
    return F.when(v.isNotNull(), F.substring(held, F.lit(2), F.length(held) - 2))


def to_json(v: Column) -> Column:
    """to_json() and to_jsonb() of any value: NULLs inside stay, NULL gives NULL."""
    held = F.to_json(F.array(v), {"ignoreNullFields": "false"})
    return F.when(v.isNotNull(), F.substring(held, F.lit(2), F.length(held) - 2))


def row_to_json(*columns: str | Column) -> Column:
    """A row as an object: NULLs stay."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _member(key: Column, value: Column) -> Column:
    return F.concat(scalar(key.cast("string")), F.lit(":"), F.coalesce(to_json(value), F.lit("null")))


def json_object(pairs: list[tuple[Column | str, Column]], absent: bool = False, unique: bool = False) -> Column:
    """JSON_OBJECT(key VALUE v, ... [NULL | ABSENT ON NULL] [WITH UNIQUE KEYS]). A NULL key is an error, as is a repeated one if ``unique``."""
    keys = [F.lit(k) if isinstance(k, str) else k for k, _ in pairs]
    wrong = F.raise_error(F.lit("null value not allowed for object key")).cast("string")
    members = [F.when(k.isNull(), wrong).when(v.isNull() & F.lit(absent), F.lit(None)).otherwise(_member(k, v)) for k, (_, v) in zip(keys, pairs, strict=True)]
    out = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*members)), ","), F.lit("}")) if pairs else F.lit("{}")
    if not unique or not pairs:
        return out
    held = F.array_compact(F.array(*(F.when(~(v.isNull() & F.lit(absent)), k.cast("string")) for k, (_, v) in zip(keys, pairs, strict=True))))
    return F.when(F.size(held) > F.size(F.array_distinct(held)), F.raise_error(F.lit("duplicate JSON object key value")).cast("string")).otherwise(out)


def json_array(*items: Column, absent: bool = True) -> Column:
    """JSON_ARRAY(v, ... [NULL | ABSENT ON NULL]) of items of any types."""
    texts = [to_json(v) if absent else F.coalesce(to_json(v), F.lit("null")) for v in items]
    return F.concat(F.lit("["), F.array_join(F.array_compact(F.array(*texts)), ","), F.lit("]")) if items else F.lit("[]")


def build_object(**fields: Column) -> Column:
    """json_build_object: NULL values stay."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"})


def build_array(*items: Column) -> Column:
    """json_build_array over items of one type: NULLs stay."""
    return F.to_json(F.array(*items), {"ignoreNullFields": "false"})


def each(j: Column) -> Column:
    """Entries (key, value) of an object, to be exploded: json_each with values as JSON text."""
    return F.map_entries(F.from_json(j, "map<string,string>"))
