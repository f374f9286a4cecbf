"""Token counts (operator 7): a map-side lookup of pre-token lengths in two tiers.

The first tier is a compact hash table, built on the driver from a bounded sample
of texts and broadcast: 64-bit hashes of frequent pre-tokens, sorted, with their
numbers of tokens. Its size is bounded by ``table_size``. What it lacks goes to
the second tier, a bounded cache in each Python worker that encodes what it does
not know. Neither tier decides a result: they only save encoding. No pre-token is
ever shuffled.
"""

from __future__ import annotations

import os
import unicodedata
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded, hash64, hashed_share, map_slices, raw, sample_fraction
from .pretok import word_level

#: Pre-tokens that a worker's cache keeps.
CACHE_PIECES = 400_000


@cache
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    book = Tokenizer.from_file(path)
    book.no_truncation()
    book.no_padding()
    return book


def normalize(texts: pa.Array) -> pa.Array:
    """NFC, then lower case character by character (so that a final sigma is like any other)."""
    if int(pc.sum(pc.utf8_length(texts)).as_py() or 0) == len(raw(texts)[1]):
        return pc.ascii_lower(texts)
    return pa.array([(t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)).replace("Σ", "σ").lower() for t in texts.to_pylist()], pa.string())


def lengths(path: str, pieces: list[bytes]) -> np.ndarray:
    """Numbers of tokens of pre-tokens, which are encoded as one text with blanks between."""
    if not pieces:
        return np.zeros(0, np.int64)
    book = library(path)
    got = np.array([-1 if w is None else w for w in book.encode(b" ".join(pieces).decode(), add_special_tokens=False).word_ids], np.int64)
    if len(got) and got.min() >= 0 and got.max() == len(pieces) - 1:
        return np.bincount(got, minlength=len(pieces))
    return np.array([len(book.encode(p.decode(), add_special_tokens=False).ids) for p in pieces], np.int64)


_cache: dict[str, dict[bytes, int]] = {}


class Counts:
    """Counts tokens of slices of texts with both tiers. ``keys``: sorted hashes; ``sizes``: their tokens."""

    def __init__(self, path: str, keys: np.ndarray, sizes: np.ndarray):
        self.path, self.keys, self.sizes = path, keys, sizes

    def __call__(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "")
        special = [t.content for t in library(self.path).get_added_tokens_decoder().values()]
        extra = np.zeros(len(texts), np.int64)
        hit = np.zeros(len(texts), bool)
        for s in special:
            hit |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if hit.any():  # a special string is one token, and what is around it are texts of their own
            out = np.zeros(len(texts), np.int64)
            rest = np.flatnonzero(~hit)
            out[rest] = self(texts.take(pa.array(rest)))
            for k in np.flatnonzero(hit):
                parts, n = [texts[int(k)].as_py()], 0
                for s in sorted(special, key=len, reverse=True):
                    n += sum(p.count(s) for p in parts)
                    parts = [q for p in parts for q in p.split(s)]
                out[k] = n + self(pa.array(parts, pa.string())).sum()
            return out
        flat, off = word_level(normalize(texts))
        if not len(flat):
            return extra
        distinct, codes = coded(flat)
        sizes = np.full(len(distinct), -1, np.int64)
        if len(self.keys):
            h = hash64(distinct)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            found = self.keys[at] == h
            sizes[found] = self.sizes[at[found]]
        missed = np.flatnonzero(sizes < 0)
        if len(missed):
            known = _cache.setdefault(self.path, {})
            pieces = distinct.take(pa.array(missed)).to_pylist()
            if len(known) + len(pieces) > CACHE_PIECES:
                known.clear()
            new = [p for p in pieces if p not in known]
            known.update(zip(new, lengths(self.path, new).tolist(), strict=True))
            sizes[missed] = [known[p] for p in pieces]
        return np.concatenate([[0], np.cumsum(sizes[codes])])[off][1:] - np.concatenate([[0], np.cumsum(sizes[codes])])[off][:-1]


def frequent(docs: DataFrame, path: str, text_col: str, table_size: int, sample_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """The first tier: hashes and lengths of the most frequent pre-tokens of a hashed sample of about ``sample_chars``."""
    total = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    share = sample_fraction(total, sample_chars)
    sample = docs.filter(hashed_share(F.col(text_col), share, 7) & (F.length(text_col) < sample_chars)).select(text_col).limit(20_000)
    seen: Counter = Counter()
    for (text,) in sample.collect():
        flat, _ = word_level(normalize(pa.array([text], pa.string())))
        seen.update(flat.to_pylist())
    top = [p for p, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:table_size] if n > 1]
    if not top:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    keys, sizes = hash64(pa.array(top, pa.binary())), lengths(path, top)
    order = np.argsort(keys)
    return keys[order], sizes[order].astype(np.int32)


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", table_size: int = 32_768, sample_chars: int = 2_000_000) -> DataFrame:
    """Count every text's tokens: (id, n_bytes, n_tokens, over_limit), a row for each input row.

    NULL counts as an empty text with no tokens. ``table_size`` bounds what is
    broadcast (12 bytes an entry), ``sample_chars`` the text it is chosen from.
    Other columns are left out; an empty table gives an empty one.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    spark = docs.sparkSession
    tier = spark.sparkContext.broadcast(frequent(rows, path, "text", table_size, sample_chars))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n = Counts(path, *tier.value)(part.column(1))
        size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
        return pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    return map_slices(rows, "text", run, f"id {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
