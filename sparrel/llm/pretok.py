"""Splitting text into pre-tokens with numpy, over whole slices of texts at once.

Two splits are known: that of byte-level vocabularies (a blank goes with the word
after it) and that of word-end vocabularies (white space is dropped). Both follow
from runs of equal character class, with rules for blanks and for English
contractions, so no regular expression runs over the text.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import raw, string_array

OTHER, LETTER, NUMBER, SPACE = range(4)
#: What may follow an apostrophe in the patterns.
SUFFIXES = ("s", "t", "m", "d", "re", "ve", "ll")


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    return out


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, where each text begins in them, each point's byte offset, and the bytes."""
    _, data = raw(texts)
    lens = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(lens)])
    if begin[-1] == len(data):
        return data, begin, np.arange(len(data) + 1), data
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    width = 1 + (cp > 0x7F).astype(np.int8) + (cp > 0x7FF) + (cp > 0xFFFF)
    return cp, begin, np.concatenate([[0], np.cumsum(width, dtype=np.int64)]), data


def _suffix_len(cp: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Length of the contraction's suffix that begins at each place, or 0."""
    out = np.zeros(len(at), np.int64)
    last = len(cp) - 1
    for s in SUFFIXES:
        ok = at + len(s) <= end
        for k, c in enumerate(s):
            ok &= cp[np.minimum(at + k, last)] == ord(c)
        out[ok & (out == 0)] = len(s)
    return out


def _runs(cp: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and class of each run, and whether the run before it is in another text."""
    cls = classes()[cp]
    new = np.ones(len(cp), bool)
    new[1:] = cls[1:] != cls[:-1]
    first = np.zeros(len(cp) + 1, bool)
    first[begin] = True
    new |= first[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(cp))
    return start, end, cls[start], first


def byte_level(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of a byte-level vocabulary: flat large_binary values and n + 1 offsets by text."""
    cp, begin, byte_at, data = _points(texts)
    if not len(cp):
        return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64)
    start, end, kind, first = _runs(cp, begin)
    cut = np.zeros(len(cp) + 1, bool)
    cut[start] = True
    ahead = ~first[end]  # another run of the same text follows
    w = (kind == SPACE) & ahead
    last = end[w] - 1
    cut[last] = True
    joined = end[w][cp[last] == 0x20]
    cut[joined] = False  # the blank goes with what follows
    begin_ok = np.zeros(len(cp) + 1, bool)
    begin_ok[start] = True
    begin_ok[joined] = False
    q = (kind == OTHER) & ahead & (end - start == 1) & (cp[start] == 0x27) & begin_ok[start]
    q[:-1] &= kind[1:] == LETTER
    q = np.flatnonzero(q)
    if len(q):
        n = _suffix_len(cp, end[q], end[q + 1])
        q, n = q[n > 0], n[n > 0]
        cut[end[q]] = False
        inside = end[q] + n < end[q + 1]
        cut[(end[q] + n)[inside]] = True
    cut[begin] = True
    at = np.flatnonzero(cut[:-1])
    off = np.append(byte_at[at], byte_at[-1])
    return string_array(data, off), np.searchsorted(at, begin)


def word_level(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of a word-end vocabulary: white space is dropped and each digit stands alone."""
    cp, begin, byte_at, data = _points(texts)
    if not len(cp):
        return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64)
    start, end, kind, first = _runs(cp, begin)
    cut = np.zeros(len(cp) + 1, bool)
    cut[start] = True
    cut[:-1] |= classes()[cp] == NUMBER
    ahead = ~first[end]
    q = (kind == OTHER) & ahead & (end - start == 1) & (cp[start] == 0x27)
    q[:-1] &= kind[1:] == LETTER
    q = np.flatnonzero(q)
    if len(q):
        n = _suffix_len(cp, end[q], end[q + 1])
        q, n = q[n > 0], n[n > 0]
        cut[end[q]] = False
        inside = end[q] + n < end[q + 1]
        cut[(end[q] + n)[inside]] = True
    at = np.flatnonzero(cut[:-1])
    off = np.append(byte_at[at], byte_at[-1])
    kept = classes()[cp[at]] != SPACE
    tokens = string_array(data, off).filter(pa.array(kept))
    return tokens, np.concatenate([[0], np.cumsum(kept)])[np.searchsorted(at, begin)]
