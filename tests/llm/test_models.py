"""The classifiers' parts against plain versions: risk and its gradient, isotonic steps, quantile bins."""

import math
import random

import numpy as np
import pytest

from cuelake.llm import quality, toxicity


def plain_risk(g, is_positive, prior):
    """(risk of positives, rest): the two terms of the non-negative risk with the logistic loss, row by row."""
    n_p, n_u = sum(is_positive), sum(not p for p in is_positive)
    as_positive = sum(math.log1p(math.exp(-x)) for x, p in zip(g, is_positive) if p) / n_p
    p_minus = sum(math.log1p(math.exp(x)) for x, p in zip(g, is_positive) if p) / n_p
    u_minus = sum(math.log1p(math.exp(x)) for x, p in zip(g, is_positive) if not p) / n_u
    return prior * as_positive, u_minus - prior * p_minus


@pytest.mark.parametrize("prior, shift", [(0.3, 0.0), (0.7, 1.0), (0.9, -4.0)])
def test_gradient_of_the_non_negative_risk(prior, shift):
    rng = np.random.default_rng(8)
    is_positive = np.array([True] * 7 + [False] * 12)
    # unlabelled rows with low outputs make the rest negative, which turns its gradient round
    g = rng.normal(size=19) + np.where(is_positive, 1.0, shift)
    got = quality._non_negative(g, 1 / (1 + np.exp(-g)), is_positive, prior)
    clipped = plain_risk(g, is_positive, prior)[1] < 0
    assert clipped == (shift == -4.0)
    goal = (lambda x: -plain_risk(x, is_positive, prior)[1]) if clipped else (lambda x: sum(plain_risk(x, is_positive, prior)))
    for k in range(19):
        step = np.zeros(19)
        step[k] = 1e-5
        assert got[k] == pytest.approx((goal(g + step) - goal(g - step)) / 2e-5, abs=1e-8)


def test_fit_lowers_the_risk_and_tells_the_classes_apart():
    rng = np.random.default_rng(2)
    positive, negative = rng.normal(1.5, 1, (300, 3)), rng.normal(-1.5, 1, (600, 3))
    unlabelled = np.concatenate([rng.normal(1.5, 1, (200, 3)), negative[:400]])
    model = quality.fit(positive, unlabelled, 1 / 3)
    good, bad = model.score(rng.normal(1.5, 1, (400, 3))), model.score(rng.normal(-1.5, 1, (400, 3)))
    assert (np.mean(good >= 0.5) + np.mean(bad < 0.5)) / 2 > 0.95  # accuracy with both classes of equal weight
    both = np.concatenate([positive, unlabelled])
    known = [True] * 300 + [False] * 600
    risk = lambda s: sum(max(0.0, x) for x in plain_risk(np.log(s / (1 - s)), known, 1 / 3))
    assert risk(np.clip(model.score(both), 1e-9, 1 - 1e-9)) < 0.5 * risk(np.full(900, 1 / 3))


def test_scores_are_sums_of_bin_weights():
    model = quality.Model(np.array([[0.0, 1.0], [5.0, 5.0]]), np.array([[0.1, 0.2, 0.3], [1.0, 2.0, 3.0]]), -1.0, 0.5)
    rows = [(-1.0, 4.0), (0.0, 5.0), (0.5, 6.0), (1.0, -math.inf), (math.inf, 5.0)]
    for (a, b), got in zip(rows, model.score(np.array(rows))):
        # a value on an edge belongs to the bin above it
        g = model.weights[0][sum(e <= a for e in (0.0, 1.0))] + model.weights[1][sum(e <= b for e in (5.0, 5.0))] - 1.0
        assert got == pytest.approx(1 / (1 + math.exp(-g)))
    assert quality.fit(np.zeros((0, 2)), np.ones((3, 2)), 0.4).score(np.ones((2, 2))).tolist() == [0.4, 0.4]


def pooled(points):
    """Pool adjacent violators: (first x, last x, mean x, value, weight) of each step of (x, y, weight) in order of x."""
    steps = []
    for x, y, w in sorted(points):
        steps.append([x, x, x * w, y * w, w])
        while len(steps) > 1 and steps[-2][3] / steps[-2][4] >= steps[-1][3] / steps[-1][4]:
            last = steps.pop()
            steps[-1] = [steps[-1][0], last[1], *(a + b for a, b in zip(steps[-1][2:], last[2:]))]
    return [(a, b, x / w, y / w, w) for a, b, x, y, w in steps]


def test_calibration_equals_pooling_by_hand(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(400):
        raw = round(rng.random(), 2)  # many ties
        rows.append((raw, float(rng.random() < raw**2)))
    fitted = toxicity.calibrate(spark.createDataFrame(rows, "raw double, label double"))
    by_raw = {}
    for raw, label in rows:
        by_raw.setdefault(raw, []).append(label)
    first = pooled([(raw, sum(y) / len(y), len(y)) for raw, y in by_raw.items()])
    second = [(x, (value * w + 0.5) / (w + 1), w) for _, _, x, value, w in first if 0 < x < 1]
    ends = [(0.0, 0.0, 1e-9), (1.0, 1.0, 1e-9)]
    bounds = sorted({(x, value) for a, b, _, value, _ in pooled([*ends, *second]) for x in (a, b)})
    grid = [n / 500 for n in range(501)]
    got = [r["prediction"] for r in fitted.transform(spark.createDataFrame([(x,) for x in grid], "raw double")).orderBy("raw").collect()]
    assert got == pytest.approx(list(np.interp(grid, *zip(*bounds))), abs=1e-9)
    assert toxicity.calibrate(spark.createDataFrame([(0.5, 1.0)], "raw double, label double")) is None
