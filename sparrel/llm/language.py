"""Language identification (operator 1): segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, by the
forward algorithm; a text is scored by its words' sums of logarithms. Probabilities
are learned by expectation maximisation over the same sums, from a bounded sample
of texts of each language. All distinct words of a slice go through the algorithm
at once: for each length, the hashes of all substrings are looked up in a table.

A word of any length is one word. Where no piece of the vocabulary stands across a
place, all segmentations pass through it, so a long word is cut there and keeps its
sum; what cannot be cut goes through the algorithm byte by byte.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BYTE, coded, hash64, hashed_share, map_slices, mix, raw, sample_fraction, words

#: Longest part in bytes that goes through the algorithm with others at once.
TOGETHER = 48
#: Bytes of a longer word in which pieces are looked for at once.
STRETCH = 1 << 20
#: Logarithm by which the probability of a piece is raised for each of its bytes, so that sums over TOGETHER bytes stay in range.
RAISE = 3.0
UNKNOWN = "und"
#: Rows of word scores that a worker keeps.
CACHE_WORDS = 250_000
#: Characters stripped from both ends of a word.
EDGES = ".,;:!?*#$%&|<>()[]{}\"'«»¿¡-_/\\0123456789"


@cache
def vocabulary(path: str) -> pa.Array:
    """The pieces of a tiktoken file without blanks at their ends, and all single bytes."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]).strip(b" ") for line in f if line.strip()}
    pieces |= {bytes([b]) for b in range(256)}
    return pa.array(sorted(p for p in pieces if p), pa.binary())


class Pieces:
    """The vocabulary as sorted hashes behind a first look at a small table of hash prefixes."""

    def __init__(self, pieces: pa.Array):
        h = hash64(pieces)
        sizes = pc.binary_length(pieces).to_numpy()
        self.lengths = frozenset(sizes.tolist())
        self.longest = max(self.lengths, default=0)
        self.order = np.argsort(h)
        self.keys = h[self.order]
        self.size = len(h)
        self.bytes = sizes[self.order]
        self.slots = np.full(1 << 20, -1, np.int32)
        low = (self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)
        self.slots[low] = np.arange(self.size)
        self.shared = np.zeros(1 << 20, bool)
        self.shared[np.flatnonzero(np.bincount(low, minlength=1 << 20) > 1)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the keys, or -1."""
        low = (h & np.uint64((1 << 20) - 1)).astype(np.int64)
        got = self.slots[low].astype(np.int64)
        got[got >= 0] = np.where(self.keys[got[got >= 0]] == h[got >= 0], got[got >= 0], -1)
        again = np.flatnonzero(self.shared[low] & (got < 0))
        if len(again):
            at = np.minimum(np.searchsorted(self.keys, h[again]), self.size - 1)
            got[again] = np.where(self.keys[at] == h[again], at, -1)
        return got


def substrings(pieces: Pieces, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pieces end in one stretch of bytes, their lengths, and the pieces, by end."""
    h = np.zeros(len(data) + 1, np.uint64)
    got = []
    with np.errstate(over="ignore"):
        for k in range(1, min(pieces.longest, len(data)) + 1):
            h = _BYTE[data[: len(data) - k + 1]] + _BASE * h[1:]
            if k in pieces.lengths:
                found = pieces.find(mix(h + np.uint64(k) * np.uint64(0xD1342543DE82EF95)))
                at = np.flatnonzero(found >= 0)
                got.append((at + k, np.full(len(at), k), found[at]))
    end, k, piece = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(end, kind="stable")
    return end[order], k[order], piece[order]


def stretches(pieces: Pieces, data: np.ndarray):
    """``substrings`` of a word of any length, a stretch of ends at a time."""
    for a in range(0, len(data), STRETCH):
        before = min(a, pieces.longest)
        end, k, piece = substrings(pieces, data[a - before : a + STRETCH])
        own = end > before
        yield end[own] + (a - before), k[own], piece[own]


def cuts(pieces: Pieces, data: np.ndarray) -> np.ndarray:
    """The places inside a word where no piece stands across."""
    across = np.zeros(len(data) + 1, np.int32)
    for end, k, _ in stretches(pieces, data):
        inside = k > 1
        np.add.at(across, end[inside] - k[inside] + 1, 1)
        np.add.at(across, end[inside], -1)
    at = np.flatnonzero(np.cumsum(across) == 0)
    return at[(at > 0) & (at < len(data))]


def parts(distinct: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of words, long ones in parts, and the word that each part belongs to."""
    off, data = raw(distinct)
    lens, start = np.diff(off), off[:-1]
    long = np.flatnonzero(lens > TOGETHER)
    if not len(long):
        return data, start, lens, np.arange(len(lens))
    rest = np.flatnonzero(lens <= TOGETHER)
    starts, sizes, owner = [start[rest]], [lens[rest]], [rest]
    for k in long.tolist():
        at = np.concatenate([[0], cuts(pieces, data[off[k] : off[k + 1]]), [lens[k]]])
        starts.append(start[k] + at[:-1])
        sizes.append(np.diff(at))
        owner.append(np.full(len(at) - 1, k))
    return data, np.concatenate(starts), np.concatenate(sizes), np.concatenate(owner)


def matches(pieces: Pieces, data: np.ndarray, start: np.ndarray, size: np.ndarray):
    """For each end place, and each length: the parts where a piece ends there, and those pieces.

    Parts are in order of falling size. The hash of a substring follows from that
    of the substring without its first byte.
    """
    with np.errstate(over="ignore"):
        for end in range(1, int(size[0]) + 1 if len(size) else 0):
            m = int(np.searchsorted(-size, -end, side="right"))  # parts that reach so far
            h = np.zeros(m, np.uint64)
            for k in range(1, min(pieces.longest, end) + 1):
                h = _BYTE[data[start[:m] + (end - k)]] + _BASE * h
                if k in pieces.lengths:
                    found = pieces.find(mix(h + np.uint64(k) * np.uint64(0xD1342543DE82EF95)))
                    at = np.flatnonzero(found >= 0)
                    if len(at):
                        yield end, k, at, found[at]


def raised(prob: np.ndarray, pieces: Pieces) -> np.ndarray:
    return prob * np.exp(RAISE * pieces.bytes)[:, None]


def forward(found, prob: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raised probability of each part's first bytes under each language, by number of bytes; and of the whole parts."""
    alpha = np.zeros((int(size[0]) + 1 if len(size) else 1, len(size), prob.shape[1]))
    alpha[0] = 1
    for end, k, at, piece in found:
        alpha[end, at] += alpha[end - k, at] * prob[piece]
    return alpha, alpha[size, np.arange(len(size))]


def long_forward(pieces: Pieces, data: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Log probability of one part of any length, whose last ``longest`` sums are kept and scaled."""
    ring = pieces.longest + 1
    alpha, log = np.zeros((ring, prob.shape[1])), np.zeros(prob.shape[1])
    alpha[0] = 1
    for end, k, piece in stretches(pieces, data):
        first = np.flatnonzero(np.diff(end, prepend=-1)).tolist()
        back = (end - k) % ring
        for a, b in zip(first, [*first[1:], len(end)], strict=True):
            place = int(end[a])
            alpha[place % ring] = (alpha[back[a:b]] * prob[piece[a:b]]).sum(0)
            if place % 8 == 0:
                most = alpha.max(0)
                alpha /= most
                log += np.log(most)
    return log + np.log(np.maximum(alpha[len(data) % ring], 1e-300))


def expected(found: list, alpha: np.ndarray, whole: np.ndarray, prob: np.ndarray, size: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected number of each piece under each language, over all segmentations."""
    beta = np.zeros_like(alpha)
    beta[size, np.arange(len(size))] = weight / np.maximum(whole, 1e-300)
    out = np.zeros_like(prob)
    for end, k, at, piece in reversed(found):
        b = prob[piece] * beta[end, at]
        beta[end - k, at] += b
        b *= alpha[end - k, at]
        for lang in range(prob.shape[1]):
            out[:, lang] += np.bincount(piece, b[:, lang], len(prob))
    return out


class Model:
    """Languages and the probability of each piece under each of them."""

    def __init__(self, pieces: pa.Array, langs: list[str], prob: np.ndarray):
        self.pieces, self.langs, self.prob = pieces, langs, prob

    def word_scores(self, distinct: pa.Array, table: Pieces) -> np.ndarray:
        """Log probability of each word under each language."""
        out = np.zeros((len(distinct), len(self.langs)))
        data, start, size, word = parts(distinct, table)
        prob = raised(self.prob, table)
        order = np.argsort(-size, kind="stable")
        n_long = int((size > TOGETHER).sum())
        for k in order[:n_long].tolist():
            out[word[k]] += long_forward(table, data[start[k] : start[k] + size[k]], self.prob)
        for a in range(n_long, len(order), 8192):
            at = order[a : a + 8192]
            at = at[size[at] > 0]
            if len(at):
                _, whole = forward(matches(table, data, start[at], size[at]), prob, size[at])
                np.add.at(out, word[at], np.log(np.maximum(whole, 1e-300)) - RAISE * size[at][:, None])
        return out


_known: dict[int, tuple[Pieces, dict[bytes, int], list]] = {}


def score(model: Model, key: int, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The most likely language of each text (its number) and its posterior probability. ``key`` names the model in the worker."""
    if key not in _known:
        _known.clear()
        _known[key] = (Pieces(model.pieces), {}, [np.zeros((0, len(model.langs)), np.float32)])
    table, known, kept = _known[key]
    flat, off = words(pc.utf8_lower(pc.fill_null(texts, "")))
    total = np.zeros((len(texts), len(model.langs)))
    if len(flat):
        distinct, codes = coded(flat)
        distinct = pc.utf8_trim(distinct, EDGES)
        names = distinct.to_pylist()
        row = np.fromiter((known.get(w, -1) for w in names), np.int64, len(names))
        new = np.flatnonzero(row < 0)
        scores = np.zeros((len(names), len(model.langs)), np.float32)
        scores[row >= 0] = kept[0][row[row >= 0]]
        scores[new] = model.word_scores(distinct.take(pa.array(new)), table)
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            kept[0] = kept[0][:0]
        room = new[: CACHE_WORDS - len(known)]
        known.update((names[i], len(kept[0]) + k) for k, i in enumerate(room.tolist()))
        kept[0] = np.concatenate([kept[0], scores[room]])
        for lang in range(len(model.langs)):
            sums = np.concatenate([[0], np.cumsum(scores[:, lang].astype(np.float64)[codes])])
            total[:, lang] = sums[off[1:]] - sums[off[:-1]]
    best = total.argmax(1)
    return best, 1 / np.exp(np.maximum(total - total.max(1, keepdims=True), -700)).sum(1)


def learning_sample(rows: DataFrame, chars_per_lang: int) -> tuple[list[str], pa.Table]:
    """The languages of rows (lang, text), and a hashed sample of about ``chars_per_lang`` characters of each.

    Of a text of more characters, so many from a hashed place on are taken. The same
    rows are taken in every run, and rows that repeat a text count once.
    """
    length = F.length("text")
    place = F.pmod(F.xxhash64("text", F.lit(6)), F.greatest(length - chars_per_lang, F.lit(1))) + 1
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(length).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(sample_fraction(n, chars_per_lang))).otherwise(share)
    text = F.when(length > chars_per_lang, F.substring("text", place.cast("int"), F.lit(chars_per_lang))).otherwise(F.col("text"))
    taken = rows.filter(hashed_share(F.xxhash64("text"), share, 5)).select("lang", text.alias("text")).distinct()
    return sorted(sizes), taken.toArrow().sort_by([("lang", "ascending"), ("text", "ascending")])


def train(docs: DataFrame, vocabulary_path: str, lang_col: str = "lang", text_col: str = "text", chars_per_lang: int = 400_000, rounds: int = 4) -> Model:
    """Learn from a hashed sample of about ``chars_per_lang`` characters of each language (a bound, not a share).

    Rows without text or language are left out; repeated rows count once. Parts of more than TOGETHER bytes that cannot be cut are scored, but
    not learned from. An empty table gives a model without languages.
    """
    langs, sample = learning_sample(docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text")), chars_per_lang)
    pieces = vocabulary(vocabulary_path)
    table = Pieces(pieces)
    single = table.bytes == 1
    prior = np.where(single, 0.5, 0.02)[:, None]
    prob = np.repeat(prior / prior.sum(), max(len(langs), 1), 1)
    if not langs:
        return Model(pieces, langs, prob)
    flat, off = words(pc.utf8_lower(sample["text"].combine_chunks()) if sample.num_rows else pa.array([], pa.string()))
    distinct, codes = coded(pc.utf8_trim(flat, EDGES))
    of = np.array([langs.index(x) for x in sample["lang"].to_pylist()], np.int64)
    key, n = np.unique(codes.astype(np.int64) * len(langs) + np.repeat(of, np.diff(off)), return_counts=True)
    weight = np.zeros((len(distinct), len(langs)))
    weight[key // len(langs), key % len(langs)] = n
    data, start, size, word = parts(distinct, table)
    order = np.argsort(-size, kind="stable")
    order = order[(size[order] > 0) & (size[order] <= TOGETHER)]
    for _ in range(rounds):
        count, up = np.zeros_like(prob), raised(prob, table)
        for a in range(0, len(order), 8192):
            at = order[a : a + 8192]
            found = list(matches(table, data, start[at], size[at]))
            alpha, whole = forward(found, up, size[at])
            count += expected(found, alpha, whole, up, size[at], weight[word[at]])
        count += prior
        prob = count / count.sum(0)
    return Model(pieces, langs, prob)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each input row.

    ``lang_pred`` is 'und' with score 0 if the text is NULL or has no letter, or if
    the model knows no language. Ties go to the first language in order. Repeated
    rows are told each, a NULL id stays NULL, an empty table gives an empty one.
    Other columns are left out.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = hash((tuple(model.langs), float(model.prob.sum()), id(model)))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        m, texts = sent.value, pc.fill_null(part.column(1), "")
        letters = pc.match_substring_regex(texts, "\\p{L}").to_numpy(zero_copy_only=False)
        if not m.langs:
            best, sure, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool)
        else:
            best, sure = score(m, key, texts)
        names = pa.array([*m.langs, UNKNOWN]).take(pa.array(np.where(letters, best, len(m.langs))))
        return pa.RecordBatch.from_arrays([part.column(0), names, pa.array(np.where(letters, sure, 0.0))], ["id", "lang_pred", "score"])

    return map_slices(rows, "text", run, f"id {rows.schema[0].dataType.simpleString()}, lang_pred string, score double")
