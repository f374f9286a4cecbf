"""Toxicity (operator 4): a factorization machine over hashed terms.

A text's features are the distinct buckets of its hashed words. The score is
sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>): the factors v learn pairs such
as an insult with a group mention, which additive weights miss. In a bounded labelled
sample, terms are chosen that are associated with the label, and terms of pairs that
a first machine over those explains badly (a score test for each pair of terms that
many texts hold), so that a pair counts whose terms say nothing alone. The machine is
fitted on the driver with numpy and broadcast (``DIMENSIONS`` buckets at most).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import coded, hash64, map_slices, words
from .labelled import labelled_sample

DIMENSIONS = 1 << 18
FACTORS = 8
#: Texts of the sample that hold a term whose pairs are tested, and the most such terms (the most frequent are taken).
PAIR_DF = 64
PAIR_TERMS = 4096
#: Characters stripped from both ends of a word.
EDGES = ".,;:!?*#$%&|<>()[]{}\"'«»¿¡-_/\\"


def terms(texts: pa.Array, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of every text, flat, and n + 1 offsets. ``active``: buckets to keep."""
    flat, off = words(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(texts)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    distinct, codes = coded(flat)
    bucket = (hash64(pc.utf8_trim(distinct, EDGES)) % np.uint64(DIMENSIONS)).astype(np.int64)
    text, bucket = np.repeat(np.arange(n), np.diff(off)), bucket[codes]
    if active is not None:
        keep = active[bucket]
        text, bucket = text[keep], bucket[keep]
    key = np.unique(text * DIMENSIONS + bucket)
    return key % DIMENSIONS, np.searchsorted(key, np.arange(n + 1) * DIMENSIONS)


def _sum_rows(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[off[1:]] - total[off[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Machine:
    """Weights of the active buckets: ``slot`` gives a bucket's row in ``w`` and ``v``, or -1."""

    def __init__(self, slot: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.slot, self.w0, self.w, self.v = slot, w0, w, v

    def margin(self, rows: np.ndarray, off: np.ndarray) -> np.ndarray:
        v = self.v[rows]
        return self.w0 + _sum_rows(self.w[rows], off) + 0.5 * (_sum_rows(v, off) ** 2 - _sum_rows(v * v, off)).sum(1)

    def score(self, texts: pa.Array) -> np.ndarray:
        bucket, off = terms(texts, self.slot >= 0)
        return sigmoid(self.margin(self.slot[bucket], off))


def in_parts(texts: pa.Array, fn, rows: int = 200) -> tuple[np.ndarray, ...]:
    """fn's arrays over a few texts at a time, put together; the last array holds offsets by text."""
    parts = [fn(texts.slice(a, rows)) for a in range(0, len(texts), rows)]
    sizes = np.concatenate([np.diff(p[-1]) for p in parts])
    return (*(np.concatenate([p[k] for p in parts]) for k in range(len(parts[0]) - 1)), np.concatenate([[0], np.cumsum(sizes)]))


def pair_terms(bucket: np.ndarray, off: np.ndarray, residual: np.ndarray, variance: np.ndarray, least_z: float) -> np.ndarray:
    """Buckets of terms in a pair for which the sum of the residuals of the texts with both is ``least_z`` deviations from 0.

    Terms on PAIR_DF texts or more are tested, PAIR_TERMS at most; all their pairs are,
    a block of terms at a time.
    """
    n = len(residual)
    df = np.bincount(bucket, minlength=DIMENSIONS)
    often = np.flatnonzero(df >= PAIR_DF)
    often = np.sort(often[np.argsort(-df[often], kind="stable")[:PAIR_TERMS]])
    if len(often) < 2:
        return often[:0]
    slot = np.full(DIMENSIONS, -1, np.int32)
    slot[often] = np.arange(len(often))
    keep = slot[bucket] >= 0
    held = np.zeros((n, len(often)), np.float32)
    held[np.repeat(np.arange(n), np.diff(off))[keep], slot[bucket[keep]]] = 1
    found = np.zeros(len(often), bool)
    r, v = residual.astype(np.float32)[:, None], variance.astype(np.float32)[:, None]
    for a in range(0, len(often), 512):
        block = held[:, a : a + 512]
        z = np.abs((block * r).T @ held) / np.sqrt(np.maximum((block * v).T @ held, 1.0))
        z[np.arange(block.shape[1]), np.arange(a, a + block.shape[1])] = 0
        hit = z >= least_z
        found |= hit.any(0)
        found[a : a + 512] |= hit.any(1)
    return often[found]


def fit(texts: pa.Array, y: np.ndarray, weights: np.ndarray, min_df: int = 5, least_z: float = 4.0, pair_z: float = 6.0, most: int = 16_384, rounds: int = 250) -> Machine:
    """Fit on the terms that ``least_z`` and ``pair_z`` choose, ``most`` of the former. With one class or no rows the score is constant."""
    none = Machine(np.full(DIMENSIONS, -1, np.int32), 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    if not len(y):
        none.w0 = float(np.log(0.01 / 0.99))
        return none
    prior = np.clip((weights * y).sum() / weights.sum(), 1e-4, 1 - 1e-4)
    none.w0 = float(np.log(prior / (1 - prior)))
    if y.min() == y.max():
        return none
    bucket, off = in_parts(texts, terms)
    row = np.repeat(np.arange(len(y)), np.diff(off))
    df1 = np.bincount(bucket, y[row], DIMENSIONS)
    df0 = np.bincount(bucket, 1 - y[row], DIMENSIONS)
    n1, n0 = y.sum(), (1 - y).sum()
    p = (df1 + df0) / (n1 + n0)
    z = np.abs(df1 / n1 - df0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    z[(df1 + df0 < min_df) | (z < least_z)] = 0
    alone = np.sort(np.argsort(-z, kind="stable")[: min(most, int((z > 0).sum()))])
    equal = np.ones(len(y))
    first = _fit_terms(bucket, off, y, equal, alone, rounds)
    guess = sigmoid(first.margin(*_slots(first.slot, bucket, off)))
    pairs = pair_terms(bucket, off, y - guess, guess * (1 - guess), pair_z)
    return _fit_terms(bucket, off, y, weights, np.union1d(alone, pairs), rounds)


def _slots(slot: np.ndarray, bucket: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the active buckets of each text, flat, and offsets."""
    at = slot[bucket]
    keep = at >= 0
    return at[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def _fit_terms(bucket: np.ndarray, off: np.ndarray, y: np.ndarray, weights: np.ndarray, chosen: np.ndarray, rounds: int, rate: float = 0.05, l2: float = 1e-3, seed: int = 3) -> Machine:
    """Fit the chosen buckets by Adam on the weighted log loss."""
    total = weights.sum()
    prior = np.clip((weights * y).sum() / total, 1e-4, 1 - 1e-4)
    slot = np.full(DIMENSIONS, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    x, off = _slots(slot, bucket, off)
    row = np.repeat(np.arange(len(y)), np.diff(off))
    rng = np.random.default_rng(seed)
    m = Machine(slot, 0.0, np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), FACTORS)))
    state = [[np.zeros_like(a), np.zeros_like(a)] for a in (np.zeros(1), m.w, m.v)]
    w0 = np.array([np.log(prior / (1 - prior))])
    size = len(chosen)
    for t in range(1, rounds + 1):
        m.w0 = float(w0[0])
        g = weights * (sigmoid(m.margin(x, off)) - y) / total
        vx = m.v[x]
        push = g[row][:, None] * (_sum_rows(vx, off)[row] - vx)
        grads = [np.array([g.sum()]), np.bincount(x, g[row], size) + l2 * m.w / max(size, 1), np.stack([np.bincount(x, push[:, k], size) for k in range(FACTORS)], 1) + l2 * m.v / max(size, 1)]
        for value, grad, (a, b) in zip((w0, m.w, m.v), grads, state, strict=True):
            a += 0.1 * (grad - a)
            b += 0.001 * (grad * grad - b)
            value -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    m.w0 = float(w0[0])
    return m


def score_texts(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each input row; a NULL text counts as empty, a NULL id stays NULL.

    Repeated rows are told each, an empty table gives an empty one. Other columns are left out.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(model.value.score(part.column(1)))], ["id", "score"])

    return map_slices(rows, "text", run, f"id {rows.schema[0].dataType.simpleString()}, score double")


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 3000) -> Machine:
    """Fit on ``labels.toxic`` of rows outside the held-out fold (crc32(doc_id) mod 5 = 0)."""
    return fit(*labelled_sample(docs, labels, "toxic", rows_per_class=rows_per_class))


def drop_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns.

    A NULL text counts as empty. Repeated rows stay or go together; an empty table stays empty.
    """
    at = docs.columns.index(text_col)
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array(model.value.score(part.column(at)) < threshold))

    return map_slices(docs, text_col, run, docs.schema)
