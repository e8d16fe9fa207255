import math
import zlib
from collections import Counter

import numpy as np
import random

from cardloom.llm import classlm
from tests.llm.helpers import empty, frame, odd_rows, prose, vocabulary

SMALL = classlm.ClassModel(classes=4, endings=3, clustered=12, known=20, rounds=3)


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def check(spark, rows, model):
    found = classlm.class_scores(frame(spark, rows), model).collect()
    counts, ends = Counter(), 0
    for doc, text in rows:
        if not held(doc):
            counts.update((text or "").encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    wanted = []
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        wanted.append((str(doc), held(doc), len(words) + 1, sum(counts[w] > 0 for w in words) + (ends > 0), n, round(base, 6)))
    assert sorted((str(r[0]), *r[1:5], round(r.base_score, 6)) for r in found) == sorted(wanted)
    assert all(r.score < 0 for r in found if r.train_tokens)
    return found


def test_counts_and_base_equal_brute_force(spark):
    draw, words = random.Random(11), vocabulary(11, 60)
    check(spark, odd_rows() + [(100 + i, prose(draw, words, draw.randint(0, 80))) for i in range(40)], SMALL)


def test_score_is_a_distribution_and_beats_the_base(spark):
    draw = random.Random(12)
    left, right = vocabulary(1, 20), vocabulary(2, 20)
    rows = [(i, " ".join(draw.choice((left, right)[k % 2]) for k in range(60))) for i in range(120)]
    found = check(spark, rows, classlm.ClassModel(classes=4, endings=2, clustered=100, known=150))
    out = [r for r in found if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)


def test_nothing_to_learn_from(spark):
    doc = next(i for i in range(100) if held(i))
    found = classlm.class_scores(frame(spark, [(doc, "a b"), (doc, None)]), SMALL).collect()
    assert [r.train_tokens for r in found] == [0, 0] and [r.n_known for r in found] == [0, 0]
    assert classlm.class_scores(empty(spark), SMALL).count() == 0


def test_exchange_move_is_the_best_of_all():
    draw = np.random.default_rng(3)
    k, classes = 5, 4
    tokens = draw.integers(0, 9, 400)
    of = np.array([0, 1, 2, 3, 0, 1, 2, 3, 4])

    def counts(of):
        matrix = np.zeros((k, k))
        np.add.at(matrix, (of[tokens[:-1]], of[tokens[1:]]), 1)
        return matrix

    def likelihood(of):
        m = counts(of)
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(m) - f(m.sum(axis=0)) - f(m.sum(axis=1))

    for word in range(8):
        pairs = list(zip(tokens[:-1], tokens[1:], strict=True))
        left, right = np.zeros(k), np.zeros(k)
        for a, b in pairs:
            left[of[a]] += b == word and a != word
            right[of[b]] += a == word and b != word
        own = float(sum(a == b == word for a, b in pairs))
        values = []
        for to in range(classes):
            moved = of.copy()
            moved[word] = to
            values.append(likelihood(moved))
        best = classlm.best_class(counts(of), int(of[word]), left, right, own, classes)
        assert values[best] >= max(values) - 1e-6
