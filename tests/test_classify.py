"""Classifiers on sparse codes against numpy on the dense matrix."""

import numpy as np
import pytest

from glimmer.operators import classify


def examples(spark, n=240, features=9, classes=3, seed=0, binary=False):
    """Sparse codes, some negative, some examples without any; labels that depend on a few features."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.gamma(2, 1, (n, features)), 1) * (rng.random((n, features)) < 0.3)
    x[:, 5] = np.where(rng.random(n) < 0.2, -x[:, 5], x[:, 5])
    x[::17] = 0
    score = np.stack([x[:, 1] - 1, x[:, 2] + 0.3 * x[:, 5], np.full(n, 0.4)], axis=1) + rng.normal(0, 0.3, (n, 3))
    y = score[:, :2].argmax(axis=1) if binary else score.argmax(axis=1)
    codes = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    rows = classify.example_rows(spark.createDataFrame(codes, "example_idx long, feature int, value double").repartition(5), spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "example_idx long, label int").repartition(3))
    return x, y, rows


def plain_objective(x, y, w, b, c):
    z = x @ w.T + b
    if z.shape[1] == 1:
        loss = (np.logaddexp(0, z[:, 0]) - y * z[:, 0]).sum()
        left = (1 / (1 + np.exp(-z[:, 0])) - y)[:, None]
    else:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        loss = -np.log(p[np.arange(len(y)), y]).sum()
        left = p - np.eye(z.shape[1])[y]
    return c * loss + np.abs(w).sum(), left


@pytest.mark.parametrize("binary, c", [(False, 0.3), (True, 0.1)])
def test_weights_are_optimal(spark, binary, c):
    x, y, rows = examples(spark, binary=binary)
    classes = 2 if binary else 3
    tolerance = 2e-4
    found = classify.l1_logistic(rows, 9, classes, c=c, tolerance=tolerance, most=300)
    assert found.missed <= tolerance and found.weights.shape == (1 if binary else 3, 9)
    best, left = plain_objective(x, y, found.weights, found.bias, c)
    slope, penalty = left.T @ x / len(y), 1 / (c * len(y))
    off = np.where(found.weights != 0, np.abs(slope + penalty * np.sign(found.weights)), np.maximum(np.abs(slope) - penalty, 0))
    assert off.max() <= 2 * tolerance and np.abs(left.sum(axis=0) / len(y)).max() <= 2 * tolerance
    w, b = np.zeros_like(found.weights), np.zeros_like(found.bias)  # plain proximal steps with one rate for all
    rate = 1 / (0.5 * np.linalg.norm(np.c_[x, np.ones(len(y))], 2) ** 2 / len(y))
    for _ in range(4000):
        _, left = plain_objective(x, y, w, b, c)
        step = w - rate * left.T @ x / len(y)
        w, b = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0), b - rate * left.sum(axis=0) / len(y)
    assert best <= plain_objective(x, y, w, b, c)[0] * (1 + 1e-3)
    order = np.argsort(-np.abs(w).sum(axis=0), kind="stable")[:3]
    assert [r.feature for r in classify.feature_ranking(found, 9, spark).orderBy("place").limit(3).collect()] == order.tolist()


def plain_tree(x, y, classes, depth):
    """(counts, feature, cut) of each node, level by level, by all cuts of all features."""

    def impurity(rows):
        counts = np.bincount(y[rows], minlength=classes)
        return len(rows) - (counts**2).sum() / max(1, len(rows))

    out, level = [], [np.arange(len(y))]
    for deep in range(depth + 1):
        below = []
        for rows in level:
            best = None
            if deep < depth and impurity(rows) > 0:
                for f in range(x.shape[1]):
                    for cut in sorted({0.0, *x[:, f]}):
                        left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                        gain = impurity(rows) - impurity(left) - impurity(right) if len(left) and len(right) else 0
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, f, cut, left, right)
            out.append((np.bincount(y[rows], minlength=classes).tolist(), best[1] if best else -1, best[2] if best else 0.0))
            if best:
                below += best[3:]
        level = below
    return out


def test_tree_equals_all_splits(spark):
    x, y, rows = examples(spark, seed=3)
    nodes = classify.tree(rows, 9, 3, depth=4)
    want = plain_tree(x, y, 3, 4)
    assert [(n.counts.tolist(), n.feature, n.cut) for n in nodes] == [(c, f, cut) for c, f, cut in want] and len(nodes) > 9
    says = {r.example_idx: r.predicted for r in classify.predicted(nodes, rows).collect()}
    for i in range(len(y)):
        at = 0
        while nodes[at].left >= 0:
            at = nodes[at].left + int(x[i, nodes[at].feature] > nodes[at].cut)
        assert says[i] == nodes[at].counts.argmax()
    gains = classify.importances(nodes, 9)
    assert abs(gains.sum() - 1) < 1e-9 and gains.argmax() in (1, 2)


def test_tree_by_quantiles_of_many_values(spark):
    x, y, rows = examples(spark, n=400, seed=4)
    nodes = classify.tree(rows, 9, 3, depth=3, bins=8)
    says = {r.example_idx: r.predicted for r in classify.predicted(nodes, rows).collect()}
    assert sum(says[i] == y[i] for i in range(400)) > 0.75 * 400


def test_empty_examples_and_none(spark):
    _, _, rows = examples(spark)
    with pytest.raises(ValueError, match="no examples"):
        classify.l1_logistic(rows.where("example_idx < 0"), 9, 3)
    with pytest.raises(ValueError, match="no examples"):
        classify.tree(rows.where("example_idx < 0"), 9, 3)
    bare = rows.where("size(at) = 0")
    nodes = classify.tree(bare, 9, 3)
    assert len(nodes) == 1 and nodes[0].counts.sum() == bare.count()
    assert np.all(classify.l1_logistic(bare, 9, 3, most=60).weights == 0)
