"""Benchmark decontamination (operator 9): pigeonhole edit matching.

An item may differ from its copy in a document by k edits (a share of its length).
It is cut into k + 1 pieces, one of which must then be in the document unchanged.
An Aho-Corasick automaton over the pieces of a block of items finds those hits in
whole texts; around each hit, Myers' bit-parallel algorithm gives the edit distance
of the whole item. Documents stay where they are; only items are broadcast, in
blocks of bounded size.

Both sides are compared in lower case, with one blank for each run of characters
that are neither letters nor digits. An item that is too short for an edit is found
as whole words only, not inside of others.
"""

from __future__ import annotations

from functools import cache, reduce

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, if_small, map_slices

ERROR_RATE = 0.06
#: Characters of items in a block.
BLOCK_CHARS = 8_000_000
_KEPT = regex.compile(r"[\p{L}\p{N}]+")


def plain(texts: pa.Array) -> pa.Array:
    """Texts as they are compared."""
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), "[^\\pL\\pN]+", " "))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length with their offsets."""
    n = errors + 1
    at = [k * len(item) // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:])]


class Pattern:
    """An item's bit masks, for the distance to any substring of a text."""

    def __init__(self, text: str):
        self.size, self.masks = len(text), {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def nearest(self, text: str) -> tuple[int, int]:
        """The least edit distance to a substring of the text, and the first end of such a substring."""
        every = (1 << self.size) - 1
        top = 1 << (self.size - 1)
        plus, minus, score = every, 0, self.size
        best, best_end = self.size, 0
        for i, c in enumerate(text):
            eq = self.masks.get(c, 0)
            vert = eq | minus
            horiz = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (every & ~(horiz | plus))
            down = plus & horiz
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best, best_end = score, i + 1
            up = up << 1 & every
            plus = (down << 1 & every) | (every & ~(vert | up))
            minus = up & vert
        return best, best_end


class Items:
    """A block of items with the automaton over their pieces."""

    def __init__(self, rows: list[tuple], error_rate: float):
        self.ids, self.texts, self.errors = [], [], []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in rows:
            if not text:
                continue
            k = int(len(text) * error_rate)
            for at, piece in pieces(text, k):
                found.setdefault(piece, []).append((len(self.ids), at + len(piece)))
            self.ids.append(item_id)
            self.texts.append(text)
            self.errors.append(k)
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, where)
        self.empty = not found
        if found:
            self.automaton.make_automaton()
        self.forward = cache(lambda i: Pattern(self.texts[i]))
        self.backward = cache(lambda i: Pattern(self.texts[i][::-1]))

    def matches(self, doc: str) -> list[tuple[int, int, int, int]]:
        """(item's number, start, end, distance) of each copy in a document, without overlaps of one item."""
        out: list[tuple[int, int, int, int]] = []
        tried: set[tuple[int, int]] = set()
        until: dict[int, int] = {}
        if self.empty:
            return out
        for last, where in self.automaton.iter(doc):
            for i, offset in where:
                at = last + 1 - offset  # where the item would begin
                if (i, at) in tried or last < until.get(i, 0):
                    continue
                tried.add((i, at))
                text, k = self.texts[i], self.errors[i]
                if doc.startswith(text, at) and at >= 0:
                    if not k and (doc[at - 1 : at].strip() or doc[at + len(text) : at + len(text) + 1].strip()):
                        continue
                    hit = (i, at, at + len(text), 0)
                else:
                    a = max(0, at - k)
                    window = doc[a : at + len(text) + k]
                    distance, end = self.forward(i).nearest(window)
                    if distance > k:
                        continue
                    _, back = self.backward(i).nearest(window[:end][::-1])
                    hit = (i, a + end - back, a + end, distance)
                until[i] = hit[2]
                out.append(hit)
        return out


def _spans(text: str, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Where matches of the compared form are in the text itself."""
    at: list[int] = []
    for m in _KEPT.finditer(text):
        if at:
            at.append(m.start() - 1)
        for i in range(m.start(), m.end()):
            at += [i] * len(text[i].lower())
    return [(at[min(a, len(at) - 1)], at[min(b, len(at)) - 1] + 1) for _, a, b, _ in found]


_built: dict = {}


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """Copies of items in documents: (id, item, start, end, distance), with code point offsets in the text.

    All documents and all items are compared. NULL and empty items match nothing,
    NULL texts hold nothing. An item that repeats gives a row for each repeat; a
    document row that repeats does too. An empty table on either side gives an empty
    one. Other columns are left out.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    names = items.select(F.xxhash64(items[item_text_col]).alias("key"), items[item_col].alias("item"))
    blocks = _blocks(items, item_text_col)
    found = []
    for block in blocks:
        sent = _load(block, error_rate)
        one = _leaks_of_block(rows, sent)
        if len(blocks) > 1:  # a block's items are held until its matches are stored
            one = cut(one, "leaks")
            sent.unpersist()
        found.append(one)
    got = reduce(DataFrame.unionByName, found)
    return got.join(if_small(cut(names, "item-names")), "key").select("id", "item", "start", "end", "distance")


def _blocks(items: DataFrame, text_col: str) -> list[DataFrame]:
    """The distinct texts of items as (key, text), in blocks of about BLOCK_CHARS characters."""
    texts = items.select(F.xxhash64(items[text_col]).alias("key"), items[text_col].alias("text")).filter("text IS NOT NULL").distinct()
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    return [texts.filter(F.pmod("key", F.lit(n)) == b) if n > 1 else texts for b in range(n)]


def _load(block: DataFrame, error_rate: float):
    got = block.toArrow()
    compared = plain(got["text"].combine_chunks()).to_pylist() if got.num_rows else []
    return block.sparkSession.sparkContext.broadcast((list(zip(got["key"].to_pylist(), compared, strict=True)), error_rate))


def _items(sent) -> Items:
    """The block of a broadcast; a worker keeps the last one."""
    if _built.get("of") is not sent:
        _built.update({"of": sent, "items": Items(*sent.value)})
    return _built["items"]


def _leaks_of_block(rows: DataFrame, sent) -> DataFrame:
    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        book = _items(sent)
        ids, item, start, end, far = [], [], [], [], []
        for k, doc in enumerate(plain(part.column(1)).to_pylist()):
            if found := book.matches(doc):
                for (i, _, _, distance), (a, b) in zip(found, _spans(part.column(1)[k].as_py(), found), strict=True):
                    ids.append(k)
                    item.append(book.ids[i])
                    start.append(a)
                    end.append(b)
                    far.append(distance)
        cols = [part.column(0).take(pa.array(ids, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(far, pa.int32())]
        return pa.RecordBatch.from_arrays(cols, ["id", "key", "start", "end", "distance"])

    return map_slices(rows, "text", run, f"id {rows.schema[0].dataType.simpleString()}, key long, start long, end long, distance int")


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text_col: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """The documents without a copy of any item, with all their columns.

    Documents with NULL or empty text stay, as do all where there are no items.
    Repeated rows stay or go together; an empty table stays empty.
    """
    at = docs.columns.index(text_col)
    blocks = _blocks(items, item_text_col)
    for block in blocks:
        sent = _load(block, error_rate)

        def run(part: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            book = _items(sent)
            return part.filter(pa.array([not book.matches(d) for d in plain(part.column(at)).to_pylist()], pa.bool_()))

        docs = map_slices(docs, text_col, run, docs.schema)
        if len(blocks) > 1:
            docs = cut(docs, "clean")
            sent.unpersist()
    return docs
