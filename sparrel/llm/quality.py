"""Quality classifier (operator 10): a linear-chain conditional random field over lines.

Every line with a word is good or bad. Its features are binned measures of the
line and of both neighbours; transition weights tie neighbouring labels. The field
is fitted to the labels of documents: all lines start with their document's label,
and lines of bad documents that the field holds to be good change sides between
rounds. A document's quality is the mean of its lines' forward-backward marginals,
weighted by length, put on the scale of a probability by a logistic curve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import coded, map_slices, raw, words
from .labelled import labelled_sample
from .lines import _by_text, lines_of
from .toxicity import in_parts, sigmoid

#: Bin edges of each measure of a line.
EDGES = {
    "words": [2, 4, 8, 16, 32, 64],
    "word_chars": [2.5, 4, 5.5, 7, 9, 14],
    "symbols": [0.001, 0.02, 0.05, 0.1, 0.2, 0.35],
    "bars": [0.001, 0.02, 0.05, 0.1],
    "marks": [0.01, 0.03, 0.08, 0.15],
    "upper": [0.02, 0.06, 0.15, 0.4, 0.8],
    "digits": [0.01, 0.05, 0.15, 0.4],
    "repeats": [0.05, 0.15, 0.3, 0.5, 0.75],
    "twice": [0.5],
}
BINS = sum(len(e) + 1 for e in EDGES.values())
#: Bins of the line, of the one before, of the one after; and for each neighbour that there is none.
WIDTH = 3 * BINS + 2
_CLASS = np.zeros((5, 256), np.uint8)
for _k, _chars in enumerate((b"#*$%&<>^~=_\\", b"|", b"!?", bytes(range(65, 91)), bytes(range(48, 58)))):
    _CLASS[_k, list(_chars)] = 1


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids of every line with a word, (lines, 3 * measures); the line's length; n + 1 offsets by text."""
    flat, off = lines_of(texts)
    tokens, word_off = words(flat)
    n = np.diff(word_off)
    has = n > 0
    byte_off, data = raw(flat)
    size = np.maximum(np.diff(byte_off), 1)
    share = [_by_text(_CLASS[k][data], byte_off) / size for k in range(5)]
    line = np.repeat(np.arange(len(flat)), n)
    chars = _by_text(pc.binary_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64), word_off) if len(tokens) else n
    if len(tokens):
        _, code = coded(tokens)
        distinct = np.bincount(np.unique(line * (int(code.max()) + 1) + code) // (int(code.max()) + 1), minlength=len(flat))
    else:
        distinct = n
    text = np.repeat(np.arange(len(texts)), np.diff(off))
    twice = np.zeros(len(flat))
    if len(flat):
        _, code = coded(flat)
        key = text * (int(code.max()) + 1) + code
        twice[:] = 1
        twice[np.unique(key, return_index=True)[1]] = 0
    per = np.maximum(n, 1)
    values = dict(zip(EDGES, (n, chars / per, share[0], share[1], share[2], share[3], share[4], 1 - distinct / per, twice), strict=True))
    ids, base = [], 0
    for name, edges in EDGES.items():
        ids.append(base + np.searchsorted(edges, values[name][has], side="right"))
        base += len(edges) + 1
    own = np.stack(ids, 1) if ids else np.zeros((0, len(EDGES)), np.int64)
    text = text[has]
    at = np.searchsorted(text, np.arange(len(texts) + 1))
    before, after = own + BINS, own + 2 * BINS
    left, right = np.full_like(own, 3 * BINS), np.full_like(own, 3 * BINS + 1)
    same = text[1:] == text[:-1]
    left[1:][same] = before[:-1][same]
    right[:-1][same] = after[1:][same]
    return np.concatenate([own, left, right], 1), size[has].astype(np.float64), at


def chains(off: np.ndarray) -> list[np.ndarray]:
    """For each place in a chain, the lines that stand there, of chains in order of falling length."""
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    lengths, starts = n[order], off[:-1][order]
    return [starts[: np.searchsorted(-lengths, -t, side="left")] + t for t in range(int(n.max()) if len(n) else 0)]


def marginals(emit: np.ndarray, step: np.ndarray, off: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected number of each transition (2 x 2). ``emit``: a line's score for good.

    ``weight``: what the transition to a line counts, 1 by default.
    """
    e = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], 1)
    e /= e.sum(1, keepdims=True)
    a, b, t = np.empty_like(e), np.ones_like(e), np.exp(step)
    places = chains(off)
    for k, at in enumerate(places):
        f = e[at] if k == 0 else (a[at - 1] @ t) * e[at]
        a[at] = f / f.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for at in reversed(places[1:]):
        back = e[at] * b[at]
        p = a[at - 1][:, :, None] * t[None] * back[:, None, :]
        p /= p.sum((1, 2), keepdims=True)
        pairs += (p if weight is None else p * weight[at][:, None, None]).sum(0)
        back = back @ t.T
        b[at - 1] = back / back.sum(1, keepdims=True)
    p = a * b
    return p[:, 1] / p.sum(1), pairs


class Field:
    """Weights for good of each feature, transition scores, and the logistic curve."""

    def __init__(self):
        self.w, self.step, self.curve = np.zeros(WIDTH), np.zeros((2, 2)), (1.0, 0.0)

    def raw_quality(self, texts: pa.Array) -> np.ndarray:
        x, size, off = line_features(pc.fill_null(texts, ""))
        good, _ = marginals(self.w[x].sum(1), self.step, off)
        total = np.maximum(_by_text(size, off), 1e-9)
        return _by_text(good * size, off) / total

    def score(self, texts: pa.Array) -> np.ndarray:
        q = np.clip(self.raw_quality(texts), 1e-3, 1 - 1e-3)
        return sigmoid(self.curve[0] * np.log(q / (1 - q)) + self.curve[1])


def gradients(field: Field, x: np.ndarray, off: np.ndarray, label: np.ndarray, weight: np.ndarray, l2: float) -> list[np.ndarray]:
    """Of the weighted negative log likelihood with the penalty, by ``field.w`` and ``field.step``. ``weight``: that of each line's text."""
    good, expected = marginals(field.w[x].sum(1), field.step, off, weight)
    first = np.zeros(len(label), bool)
    first[off[:-1][np.diff(off) > 0]] = True
    to = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[to - 1].astype(int), label[to].astype(int)), weight[to])
    return [np.bincount(x.ravel(), np.repeat((good - label) * weight, x.shape[1]), WIDTH) + l2 * field.w, expected - seen + l2 * field.step]


def fit(texts: pa.Array, y: np.ndarray, weights: np.ndarray, rounds: int = 3, steps: int = 60, rate: float = 0.1, l2: float = 1e-4) -> Field:
    """Fit by Adam on one objective: the chains' log likelihood given the lines' labels, summed over texts with the
    weight 0.5 / (texts of the class) / (lines of the text), less ``l2`` / 2 times the squares of all weights.

    With one class or no rows all weights stay 0, so all scores are 0.5 (texts without words less).
    """
    field = Field()
    if not len(y) or y.min() == y.max():
        return field
    x, size, off = in_parts(pc.fill_null(texts, ""), line_features)
    text = np.repeat(np.arange(len(y)), np.diff(off))
    label = y[text].copy()
    balance = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) / np.maximum(np.diff(off), 1)
    lw = balance[text]
    params = [field.w, field.step]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    t = 0
    for turn in range(rounds):
        for _ in range(steps):
            t += 1
            grads = gradients(field, x, off, label, lw, l2)
            for value, grad, (a, b) in zip(params, grads, state, strict=True):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                value -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        if turn + 1 < rounds:
            good, _ = marginals(field.w[x].sum(1), field.step, off)
            label = np.where((y[text] == 0) & (good > 0.7), 1.0, y[text])
    good, _ = marginals(field.w[x].sum(1), field.step, off)
    q = np.clip(_by_text(good * size, off) / np.maximum(_by_text(size, off), 1e-9), 1e-3, 1 - 1e-3)
    field.curve = _curve(np.log(q / (1 - q)), y, weights)
    return field


def _curve(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        g, h = weights * (p - y), weights * p * (1 - p) + 1e-9
        grad = np.array([(g * z).sum() + 1e-2 * (a - 1), g.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum()]])
        move = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 2000) -> Field:
    """Fit on ``labels.quality`` of rows outside the held-out fold (crc32(doc_id) mod 5 = 0)."""
    return fit(*labelled_sample(docs, labels, "quality", rows_per_class=rows_per_class))


def score_texts(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each input row.

    A text that is NULL or without words has quality 0 before the curve, so the least
    score; a NULL id stays NULL. Repeated rows are told each, an empty table gives an
    empty one. Other columns are left out.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(field)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(model.value.score(part.column(1)))], ["id", "score"])

    return map_slices(rows, "text", run, f"id {rows.schema[0].dataType.simpleString()}, score double")
