"""Text: where Spark's functions differ from a SQL database's."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType


def concat(*cols: Column) -> Column:
    """concat() leaves NULLs out."""
    return F.concat_ws("", *cols)


def initcap(s: Column) -> Column:
    """A word is a run of letters and digits; its first letter is upper case, the others lower."""
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), "")


def left(s: Column, n: int) -> Column:
    """First n characters; a negative n leaves the last ones out."""
    return F.left(s, F.lit(n)) if n >= 0 else F.left(s, F.greatest(F.length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    """Last n characters; a negative n leaves the first ones out."""
    return F.right(s, F.lit(n)) if n >= 0 else F.right(s, F.greatest(F.length(s) + n, F.lit(0)))


def substring(s: Column, start: int, length: int | None = None) -> Column:
    """Characters from start (1 is the first); places before 1 use up length."""
    if length is None:
        return F.substr(s, F.lit(max(start, 1)))
    if length < 0:
        raise ValueError("negative substring length not allowed")
    end = start + length
    begin = max(start, 1)
    return F.when(s.isNotNull(), F.lit("")) if end <= begin else F.substr(s, F.lit(begin), F.lit(end - begin))


def chr_(n: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32")


def ascii_(s: Column) -> Column:
    """The code point of the first character; 0 for an empty text."""
    return F.when(s == "", F.lit(0)).otherwise(F.conv(F.hex(F.encode(F.left(s, F.lit(1)), "UTF-32")), 16, 10).cast("int"))


def strpos(s: Column, part: Column | str) -> Column:
    return F.instr(s, part if isinstance(part, Column) else F.lit(part))


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n.cast("bigint")))


def to_oct(n: Column) -> Column:
    return F.conv(n.cast("string"), 10, 8)


def to_bin(n: Column) -> Column:
    return F.bin(n.cast("bigint"))


def regexp_replace(s: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    r"""Replaces the first match, all of them with flag g. \1 and \& in the replacement are groups and the match."""
    given = re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$")).replace(r"\&", "$0")
    if "i" in flags:
        pattern = "(?i)" + pattern
    if "g" in flags:
        return F.regexp_replace(s, pattern, given)
    shift = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 2}", given)
    return F.regexp_replace(s, rf"(?s)\A((?:(?!{pattern}).)*)({pattern})", "$1" + shift)


def regexp_match(s: Column, pattern: str, flags: str = "") -> Column:
    """Groups of the first match (the match if there are none) as an array; NULL without a match."""
    if "i" in flags:
        pattern = "(?i)" + pattern
    n = re.compile(pattern).groups
    got = [F.regexp_extract(s, pattern, k) for k in (range(1, n + 1) if n else range(1))]
    return F.when(s.rlike(pattern), F.array(*got))


def similar_to(s: Column, pattern: str, escape: str = "\\") -> Column:
    """SIMILAR TO, by a regular expression."""
    return s.rlike(similar_pattern(pattern, escape))


def similar_pattern(pattern: str, escape: str = "\\") -> str:
    out, inside, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == escape and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        elif inside:
            inside = c != "]"
            out.append("\\\\" if c == "\\" else c)
        elif c == "[":
            inside = True
            out.append(c)
        elif c in "%_":
            out.append(".*" if c == "%" else ".")
        elif c in "|*+?{}()":
            out.append("(?:" if c == "(" else c)
        else:
            out.append(re.escape(c))
        at += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def quote_literal(s: Column) -> Column:
    body = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.concat(F.when(F.contains(s, F.lit("\\")), F.lit(" E'")).otherwise(F.lit("'")), body, F.lit("'"))


def quote_nullable(s: Column) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def quote_ident(s: Column) -> Column:
    """Quotes unless the name is plain lower case. Keywords are not known here."""
    return F.when(s.rlike(r"^[a-z_][a-z0-9_$]*$"), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def format_(pattern: str, *args: Column) -> Column:
    """format() with %s, %I, %L, %%, positions (n$) and widths."""
    out, taken, at = [], 0, 0
    for m in re.finditer(r"%(?:(\d+)\$)?(-)?(\d+)?([sIL%])", pattern):
        out.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        if m[4] == "%":
            out.append(F.lit("%"))
            continue
        k = int(m[1]) - 1 if m[1] else taken
        taken = k + 1
        s = args[k].cast("string")
        s = F.coalesce(s, F.lit("")) if m[4] == "s" else quote_ident(s) if m[4] == "I" else quote_nullable(s)
        if m[3]:
            wide = F.greatest(F.length(s), F.lit(int(m[3])))
            s = F.rpad(s, wide, F.lit(" ")) if m[2] else F.lpad(s, wide, F.lit(" "))
        out.append(s)
    return F.concat(*out, F.lit(pattern[at:]))


def split_part(s: Column, separator: str, n: int) -> Column:
    return F.split_part(s, F.lit(separator), F.lit(n))


@pandas_udf(StringType())
def unistr(s: pd.Series) -> pd.Series:
    r"""Escapes \XXXX, \+XXXXXX, \uXXXX, \UXXXXXXXX and \\."""
    pattern = re.compile(r"\\(?:\\|\+([0-9A-Fa-f]{6})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|([0-9A-Fa-f]{4}))")

    def one(m: re.Match) -> str:
        code = next((g for g in m.groups() if g), None)
        return "\\" if code is None else chr(int(code, 16))

    return s.map(lambda x: pattern.sub(one, x), na_action="ignore")


def normalize(s: Column, form: str = "NFC") -> Column:
    @pandas_udf(StringType())
    def run(x: pd.Series) -> pd.Series:
        import unicodedata

        return x.map(lambda v: unicodedata.normalize(form, v), na_action="ignore")

    return run(s)


@pandas_udf(ArrayType(StringType()))
def parse_ident(s: pd.Series) -> pd.Series:
    """Parts of a qualified name: quoted ones as they are, others in lower case."""

    def one(x: str) -> list[str]:
        parts = re.findall(r'\s*(?:"((?:[^"]|"")*)"|([^\s."]+))\s*(?:\.|$)', x)
        return [a.replace('""', '"') if a else b.lower() for a, b in parts]

    return s.map(one, na_action="ignore")


@pandas_udf(LongType())
def crc32c(s: pd.Series) -> pd.Series:
    """CRC-32C (Castagnoli) of text in UTF-8."""
    rows = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0x82F63B78 if k & 1 else 0)
        rows.append(k)

    def one(x: str) -> int:
        c = 0xFFFFFFFF
        for b in x.encode():
            c = rows[(c ^ b) & 255] ^ c >> 8
        return c ^ 0xFFFFFFFF

    return s.map(one, na_action="ignore")


def get_byte(b: Column, n: int) -> Column:
    """Byte n of a binary, counted from 0."""
    return F.conv(F.hex(F.substring(b, n + 1, 1)), 16, 10).cast("int")


def set_byte(b: Column, n: int, value: int) -> Column:
    h = F.hex(b)
    return F.unhex(F.concat(F.left(h, F.lit(2 * n)), F.lit(f"{value:02X}"), F.substr(h, F.lit(2 * n + 3))))


def encode(b: Column, form: str) -> Column:
    """Binary to text: hex or base64."""
    return F.lower(F.hex(b)) if form == "hex" else F.base64(b)


def decode(s: Column, form: str) -> Column:
    return F.unhex(s) if form == "hex" else F.unbase64(s)
