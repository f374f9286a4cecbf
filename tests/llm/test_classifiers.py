"""Classifiers against explicit loops, enumeration and numerical gradients; their sample."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparrel.llm import labelled, quality, toxicity


def test_pair_sum_equals_a_double_loop():
    rng = np.random.default_rng(2)
    names = [f"t{k}" for k in range(50)]
    slot = np.full(toxicity.DIMENSIONS, -1, np.int32)
    buckets = {n: int(toxicity.terms(pa.array([n]))[0][0]) for n in names}
    for k, n in enumerate(names[:40]):  # ten terms are not active
        slot[buckets[n]] = k
    machine = toxicity.Machine(slot, 0.3, rng.normal(size=40), rng.normal(size=(40, toxicity.FACTORS)))
    texts = [None, "", "t1", "T1, t2! t2", *(" ".join(rng.choice(names, rng.integers(1, 30))) for _ in range(50))]
    want = []
    for text in texts:
        held = sorted({slot[buckets[w.lower().strip(toxicity.EDGES)]] for w in (text or "").split()} - {-1})
        m = machine.w0 + sum(machine.w[i] for i in held)
        for i, j in itertools.combinations(held, 2):
            m += sum(machine.v[i][f] * machine.v[j][f] for f in range(toxicity.FACTORS))
        want.append(1 / (1 + math.exp(-max(-40, min(40, m)))))
    assert np.allclose(machine.score(pa.array(texts)), want)


@pytest.mark.parametrize("label", [lambda a, b: a != b, lambda a, b: a and b, lambda a, b: a == b])
def test_machine_learns_pairs_whose_terms_say_nothing_alone(label):
    rng = np.random.default_rng(1)
    filler = [f"w{k}" for k in range(300)]
    rows, y = [], []
    for _ in range(4000):
        a, b = rng.integers(0, 2), rng.integers(0, 2)
        rows.append(" ".join(rng.permutation([*rng.choice(filler, 30), *["insult"] * a, *["group"] * b])))
        y.append(float(label(a, b)))
    machine = toxicity.fit(pa.array(rows[:3000]), np.array(y[:3000]), np.ones(3000))
    assert ((machine.score(pa.array(rows[3000:])) >= 0.5) == (np.array(y[3000:]) == 1)).mean() > 0.99


def _enumerate(emit, step):
    """P(good) of each line and the expected transitions, over all labellings."""
    n, total, good, pairs = len(emit), 0.0, np.zeros(len(emit)), np.zeros((2, 2))
    for labels in itertools.product((0, 1), repeat=n):
        p = math.exp(sum(e for e, y in zip(emit, labels, strict=True) if y) + sum(step[a, b] for a, b in zip(labels, labels[1:])))
        total += p
        good += p * np.array(labels)
        for a, b in zip(labels, labels[1:]):
            pairs[a, b] += p
    return good / total, pairs / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    sizes = [1, 5, 0, 3, 8, 1, 2]
    off = np.concatenate([[0], np.cumsum(sizes)])
    emit, step, weight = rng.normal(size=off[-1]) * 2, rng.normal(size=(2, 2)), rng.random(off[-1])
    good, pairs = quality.marginals(emit, step, off)
    _, weighted = quality.marginals(emit, step, off, np.repeat(weight[: len(sizes)], sizes))
    each = [_enumerate(emit[a:b], step) for a, b in zip(off, off[1:])]
    assert np.allclose(good, np.concatenate([g for g, _ in each]))
    assert np.allclose(pairs, sum(p for _, p in each))
    assert np.allclose(weighted, sum(w * p for w, (_, p) in zip(weight, each)))


def test_gradients_are_those_of_one_objective():
    rng = np.random.default_rng(4)
    sizes = [3, 0, 5, 1, 4]
    off = np.concatenate([[0], np.cumsum(sizes)])
    n, l2 = int(off[-1]), 0.01
    x = rng.integers(0, quality.WIDTH, (n, 6))
    label, weight = rng.integers(0, 2, n).astype(float), np.repeat(rng.random(len(sizes)), sizes)
    field = quality.Field()
    field.w, field.step = rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2))

    def objective():
        total = l2 / 2 * ((field.w**2).sum() + (field.step**2).sum())
        for k, (a, b) in enumerate(zip(off, off[1:])):
            if a == b:
                continue
            emit = field.w[x[a:b]].sum(1)
            value = lambda labels: sum(e for e, y in zip(emit, labels) if y) + sum(field.step[int(p), int(q)] for p, q in zip(labels, labels[1:]))  # noqa: E731, B023
            total -= weight[a] * (value(label[a:b]) - math.log(sum(math.exp(value(y)) for y in itertools.product((0, 1), repeat=b - a))))
        return total

    for values, grad in zip((field.w, field.step), quality.gradients(field, x, off, label, weight, l2), strict=True):
        for at in list(np.ndindex(values.shape))[:40]:
            values[at] += 1e-5
            up = objective()
            values[at] -= 2e-5
            down = objective()
            values[at] += 1e-5
            assert math.isclose(grad[at], (up - down) / 2e-5, rel_tol=1e-4, abs_tol=1e-6)


def test_labelled_sample(spark):
    rng = random.Random(1)
    texts = [(k, "long " * 60_000 if k % 40 == 0 else f"text {k}") for k in range(2000)]
    labels = [(k, int(k % 10 == 0)) for k in range(2000)] + [(k, k % 2 * 5) for k in range(3000, 3010)] + [(None, 1), (1, None), (10, 1), (10, 1)]
    docs = spark.createDataFrame([*texts, (10, "text 10"), (None, "x"), (11, None)], "doc_id long, text string").repartition(4)
    rng.shuffle(labels)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = labelled.labelled_sample(docs, known, "toxic", rows_per_class=100)
    again = labelled.labelled_sample(docs.repartition(2), known, "toxic", rows_per_class=100)
    assert got[0].equals(again[0]) and (got[1] == again[1]).all()
    assert 60 < (got[1] == 0).sum() < 150 and 60 < (got[1] == 1).sum() < 150
    share = {y: w for y, w in zip(got[1].tolist(), (got[2] / len(got[1])).tolist())}
    assert abs(share[1.0] * (got[1] == 1).sum() - 0.1) < 0.02
    assert max(map(len, got[0].to_pylist())) == labelled.CHARS_PER_TEXT  # long texts keep their chance
    by_text = dict((t, k) for k, t in texts)
    assert all(zlib.crc32(str(by_text[t]).encode()) % 5 for t in got[0].to_pylist() if t in by_text and t.startswith("text"))
    few = labelled.labelled_sample(docs, known, "toxic", rows_per_class=400, chars_per_class=400_000)
    assert sum(map(len, few[0].to_pylist())) < 2_000_000
    crowd = spark.createDataFrame([(10, f"copy {k}") for k in range(4000)], "doc_id long, text string")  # one id with very many texts
    assert len(labelled.labelled_sample(docs.union(crowd), known, "toxic", rows_per_class=100)[1]) < 500
    assert collections.Counter(labelled.labelled_sample(docs, known.limit(0), "toxic")[1]) == {}


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_scores_of_odd_rows(spark, operator):
    rows = [(k, f"word{k % 7} bad" if k % 2 else f"word{k % 7} good\nsecond line of {k}", "x") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(200)], "doc_id long, toxic int, quality int")
    model = operator.train(docs, labels)
    odd = spark.createDataFrame([(1, "bad", "a"), (1, "bad", "a"), (None, "bad", "b"), (2, None, "c"), (3, "", "d"), (4, "bad " * 200_000, "e")], "doc_id long, text string, score string")
    got = [(r["id"], r["score"]) for r in operator.score_texts(odd, model).collect()]
    assert sorted((i for i, _ in got), key=repr) == sorted([1, 1, None, 2, 3, 4], key=repr)
    by_id = dict(got)
    assert by_id[2] == by_id[3] and all(0 <= s <= 1 for _, s in got) and len({s for i, s in got if i == 1}) == 1 and by_id[1] == by_id[None]
    assert operator.score_texts(odd.limit(0), model).count() == 0
