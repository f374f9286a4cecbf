"""Quality rules (operator 3): word counts and repeats, and cross-document line frequency.

Lines are normalised (A-Z in lower case, runs of digits as 0, runs of white space
as one blank) and hashed. For each host, the documents that hold a line are counted.
A line in more of them than its limit is removed. The limit is a number of documents
that depends on the line's words, or half of the host's documents where these are few.
A document that is left with too small a share of its words is depleted and
rejected.

One pass of numpy over whole texts gives a small row for each document, which is
written to the shared folder. All else are DataFrame aggregations and joins over
hashes, with partial aggregation before each shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded, cut, hash64, if_small, map_slices, mix, raw, signed, words

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Words from which a line counts as long.
LONG = 6
#: Documents up to which a line is never above its limit, on however small a host.
FEWEST = 4
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_SALT = np.uint64(0x632BE59BD9B4E019)


def lines_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The \\n-split lines of all texts, flat, and n + 1 offsets."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    off = np.asarray(parts.offsets).astype(np.int64)
    return parts.flatten(), off - off[0]


def normal(lines: pa.Array) -> pa.Array:
    lines = pc.replace_substring_regex(pc.ascii_lower(lines), "[0-9]+", "0")
    return pc.ascii_trim_whitespace(pc.replace_substring_regex(lines, "[\\x20\\x09-\\x0D]+", " "))


def line_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """For each line: its normalised hash and its words; the offsets by text; and the lines."""
    flat, off = lines_of(texts)
    _, word_off = words(flat)
    return hash64(normal(flat)), np.diff(word_off), off, flat


def _by_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def repeat_words(flat: pa.Array, off: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window of WINDOW words which the text has twice or more."""
    n = len(flat)
    if n < WINDOW:
        return np.zeros(len(off) - 1, np.int64)
    distinct, codes = coded(flat)
    w = hash64(distinct)[codes]
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    whole = text[: n - WINDOW + 1] == text[WINDOW - 1 :]
    h = np.zeros(n - WINDOW + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            h = h * _SALT + w[k : n - WINDOW + 1 + k]
        h = mix(h + text[: len(h)].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    at = np.flatnonzero(whole)
    _, inverse, count = np.unique(h[at], return_inverse=True, return_counts=True)
    at = at[count[inverse] >= 2]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return _by_text((np.cumsum(step)[:n] > 0).astype(np.int64), off)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each input row: (id, host, text_hash, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, lines array<long>, line_words array<int>, line_sizes array<int>).

    ``lines`` holds the distinct hashes of normalised lines with a word,
    ``line_words`` the words in all their copies in the text, ``line_sizes`` those
    in one copy. NULL texts count as empty, NULL hosts as ''.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[host_col].cast("string"), F.lit("")).alias("host"), docs[text_col].alias("text"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(part.column(2), "")
        flat, off = words(texts)
        byte_off, data = raw(texts)
        h, n, line_off, lines = line_hashes(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(line_off))
        has = n > 0
        dup = _by_text(has.astype(np.int64), line_off)
        if has.any():
            _, code = coded(lines)
            pairs = np.unique(text[has] * (int(code.max()) + 1) + code[has])
            dup -= np.bincount(pairs // (int(code.max()) + 1), minlength=len(texts))
        # distinct normalised lines of each text, with all words in them
        order = np.lexsort((h[has], text[has]))
        t, g, m = text[has][order], h[has][order], n[has][order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(m, at) if len(at) else m
        list_off = pa.array(np.searchsorted(t[at], np.arange(len(texts) + 1)), pa.int32())
        chars = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
        cols = [
            part.column(0), part.column(1), pa.array(signed(hash64(texts))), pa.array(np.diff(off), pa.int64()), pa.array(_by_text(chars, off), pa.int64()),
            pa.array(_by_text(_IS_SYMBOL[data], byte_off), pa.int64()), pa.array(dup, pa.int64()), pa.array(repeat_words(flat, off), pa.int64()),
            pa.ListArray.from_arrays(list_off, pa.array(signed(g[at]))), pa.ListArray.from_arrays(list_off, pa.array(total, pa.int32())),
            pa.ListArray.from_arrays(list_off, pa.array(m[at], pa.int32())),
        ]
        return pa.RecordBatch.from_arrays(cols, ["id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words", "line_sizes"])

    kind = rows.schema[0].dataType.simpleString()
    return map_slices(rows, "text", run, f"id {kind}, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>, line_sizes array<int>")


def _exploded(measured: DataFrame) -> DataFrame:
    return measured.select("host", "text_hash", "n_words", F.explode(F.arrays_zip("lines", "line_words", "line_sizes")).alias("z")).select("host", "text_hash", "n_words", F.col("z.lines").alias("line"), F.col("z.line_words").alias("words"), F.col("z.line_sizes").alias("size"))


def frequent_lines(measured: DataFrame, least: int, texts: bool = False) -> DataFrame:
    """Lines above their limit: (host, line, n_docs).

    The limit is ``least`` documents, half of that for a line of LONG words or more, and
    five times that for one of two words or fewer, which documents may share by chance;
    but no more than half of the host's documents, or FEWEST where that is more. Rows
    with one id and text are one document. ``texts`` counts distinct texts instead, so
    that copies of a page count once.
    """
    doc = F.col("text_hash") if texts else F.xxhash64("id", "text_hash")
    docs = measured.select("host", doc.alias("doc")).groupBy("host", "doc").agg(F.count("*").alias("rows"))
    hosts = docs.groupBy("host").agg(F.count("*").alias("docs"), F.max("rows").alias("rows"))
    hosts = cut(hosts, "hosts")
    each = measured.withColumn("doc", doc).select("host", "doc", F.explode(F.arrays_zip("lines", "line_sizes")).alias("z")).select("host", "doc", F.col("z.lines").alias("line"), F.col("z.line_sizes").alias("size"))
    if not hosts.filter("rows > 1").isEmpty():  # a document's lines are distinct; rows that repeat it are folded
        each = each.groupBy("host", "line", "doc").agg(F.max("size").alias("size"))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.max("size").alias("size"))
    limit = F.when(F.col("size") <= 2, F.lit(5.0 * least)).when(F.col("size") >= LONG, F.lit(least / 2)).otherwise(F.lit(float(least)))
    known = counts.filter(F.col("n_docs") > F.least(limit, F.lit(float(FEWEST))))
    most = F.least(limit, F.greatest(F.lit(float(FEWEST)), F.col("docs") / 2))
    return known.join(if_small(hosts.select("host", "docs")), "host").filter(F.col("n_docs") > most).select("host", "line", "n_docs")


def removals(measured: DataFrame, least: int, texts: bool = False) -> DataFrame:
    """For each text with a line above the limit: (host, text_hash, n_words, removed_words, removed array<long>)."""
    frequent = cut(frequent_lines(measured, least, texts), "frequent-lines")
    hit = _exploded(measured).join(if_small(frequent.select("host", "line")), ["host", "line"])
    hit = hit.groupBy("host", "text_hash", "n_words", "line").agg(F.max("words").alias("words"))
    return hit.groupBy("host", "text_hash", "n_words").agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least: int = 20, texts: bool = False, keep_share: float = 0.5) -> DataFrame:
    """Measures and verdict of every document, a row for each input row:
    (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, kept).

    ``base_failed``: under 20 words, or over 30 % of the words in repeated windows.
    ``kept``: not base_failed, and at least ``keep_share`` of the words are left
    after removal of lines above their limit (see ``frequent_lines``). NULL and empty texts fail the base
    rules; documents with NULL host share one; a NULL id stays NULL. Repeated rows get
    the same verdict; an empty table gives an empty one; other columns are left out.
    """
    m = cut(measures(docs, id_col, text_col, host_col), "line-measures")
    out = m.drop("lines", "line_words", "line_sizes").join(removals(m, least, texts).drop("removed"), ["host", "text_hash", "n_words"], "left")
    gone = F.coalesce("removed_words", F.lit(0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = ~failed & (F.col("n_words") - gone >= F.col("n_words") * F.lit(keep_share))
    return out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", gone.alias("removed_words"), failed.alias("base_failed"), kept.alias("kept"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least: int = 20, texts: bool = False, keep_share: float = 0.5) -> DataFrame:
    """The documents that the rules keep, with all their columns, and their texts without the removed lines.

    Columns named ``_host`` or the like in ``docs`` do not clash: what is joined is
    one struct column with a name that ``docs`` lacks. NULLs, repeated rows and empty
    tables as in ``quality_rules``.
    """
    m = cut(measures(docs, id_col, text_col, host_col), "line-measures")
    out = m.groupBy("host", "text_hash", "n_words").agg(F.max("n_repeat_words").alias("n_repeat_words"))
    out = out.join(removals(m, least, texts), ["host", "text_hash", "n_words"], "left")
    gone = F.coalesce("removed_words", F.lit(0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = ~failed & (F.col("n_words") - gone >= F.col("n_words") * F.lit(keep_share))
    verdict = out.filter(kept).select("host", "text_hash", F.coalesce("removed", F.array().cast("array<long>")).alias("removed"))
    mark = "_" + "_".join(docs.columns)
    keyed = _with_hash(docs, text_col, mark)
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    verdict = verdict.select(F.struct("*").alias(mark + "v"))
    got = keyed.join(verdict, (host == F.col(mark + "v.host")) & (F.col(mark) == F.col(mark + "v.text_hash")))
    return _without_lines(got.withColumn(mark, F.col(mark + "v.removed")).drop(mark + "v"), text_col, mark)


def _with_hash(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    at = docs.columns.index(text_col)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(signed(hash64(part.column(at))))], [*part.schema.names, name])

    from pyspark.sql.types import LongType, StructField, StructType

    return map_slices(docs, text_col, run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def _without_lines(docs: DataFrame, text_col: str, removed: str) -> DataFrame:
    """Drop the lines whose hashes are in the column ``removed``, and that column."""
    at, gone_at = docs.columns.index(text_col), docs.columns.index(removed)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        gone = part.column(gone_at).to_pylist()
        texts = part.column(at).to_pylist()
        if hit := [k for k, g in enumerate(gone) if g]:
            h, n, off, flat = line_hashes(pa.array([texts[k] for k in hit], pa.string()))
            flat = flat.to_pylist()
            h = signed(h)
            for j, k in enumerate(hit):
                a, b = off[j], off[j + 1]
                stays = ~np.isin(h[a:b], np.array(gone[k], np.int64)) | (n[a:b] == 0)
                texts[k] = "\n".join(flat[i] for i in np.flatnonzero(stays) + a)
        cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(part.columns) if i != gone_at]
        return pa.RecordBatch.from_arrays(cols, [x for i, x in enumerate(part.schema.names) if i != gone_at])

    from pyspark.sql.types import StructType

    return map_slices(docs, text_col, run, StructType([f for f in docs.schema.fields if f.name != removed]))
