"""JSON_TABLE: rows from JSON by a row path and columns, with nested paths."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jsonpath


@dataclass
class Value:
    """A regular column: the scalar of a path as ``kind``; ``json``: keep it as JSON text."""

    name: str
    kind: str = "string"
    path: str | None = None
    json: bool = False
    on_empty: str | None = None
    on_error: str | None = None


@dataclass
class Exists:
    """True if the path has an item."""

    name: str
    path: str


@dataclass
class Ordinality:
    """Number of the row among those of its parent."""

    name: str


@dataclass
class Nested:
    """Rows of a path below each row; siblings are united, their other columns NULL."""

    path: str
    columns: list = field(default_factory=list)


def _names(columns: list) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for c in columns:
        if isinstance(c, Nested):
            out += _names(c.columns)
        else:
            out.append((c.name, "int" if isinstance(c, Ordinality) else "boolean" if isinstance(c, Exists) else c.kind))
    return out


def _cell(c, item, number: int):
    if isinstance(c, Ordinality):
        return str(number)
    try:
        got = jsonpath.query(item, c.path or f'$."{c.name}"')
    except (jsonpath.PathError, IndexError):
        return "false" if isinstance(c, Exists) else c.on_error
    if isinstance(c, Exists):
        return str(bool(got)).lower()
    if not got:
        return c.on_empty
    if c.json:
        return json.dumps(got[0] if len(got) == 1 else got, ensure_ascii=False)
    if len(got) > 1 or isinstance(got[0], (dict, list)):
        return c.on_error
    v = got[0]
    return None if v is None else v if isinstance(v, str) else json.dumps(v)


def _rows(items: list, columns: list) -> list[dict]:
    out = []
    for number, item in enumerate(items, 1):
        own = {c.name: _cell(c, item, number) for c in columns if not isinstance(c, Nested)}
        below = []
        for c in columns:
            if isinstance(c, Nested):
                try:
                    below += _rows(jsonpath.query(item, c.path), c.columns)
                except (jsonpath.PathError, IndexError):
                    continue
        out += [own | b for b in below] or [own]
    return out


def json_table(df: DataFrame, json_col: str, row_path: str, columns: list) -> DataFrame:
    """Each row of ``df`` joined with the rows of its JSON text; NULL and text without rows give none."""
    names = _names(columns)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(json_col)
            keep, found = [], []
            for k, text in enumerate(batch.column(at).to_pylist()):
                if text is None:
                    continue
                try:
                    items = jsonpath.query(json.loads(text), row_path)
                except (jsonpath.PathError, IndexError, ValueError):
                    continue
                rows = _rows(items, columns)
                keep += [k] * len(rows)
                found += rows
            taken = batch.take(pa.array(keep, pa.int64()))
            cells = [pa.array([r.get(n) for r in found], pa.string()) for n, _ in names]
            yield pa.RecordBatch.from_arrays([*taken.columns, *cells], [*batch.schema.names, *(n for n, _ in names)])

    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*df.schema.fields, *(StructField(n, StringType()) for n, _ in names)])
    out = df.mapInArrow(run, schema)
    return out.select(*df.columns, *(F.col(n) if kind == "string" else F.col(n).try_cast(kind).alias(n) for n, kind in names))
