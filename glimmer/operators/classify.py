"""Classifiers on pooled sparse codes, and the ranking of features that they imply.

Examples are rows (key, label, at, of): the features with codes, ascending, and their values; all other values are zero and
are never made. Both classifiers go over the examples in passes, each of which ends in sums of fixed size.

* l1_logistic minimises C * sum of losses + sum of absolute weights (intercepts are free): accelerated proximal gradient
  steps, restarted when they overshoot, in the metric of a diagonal bound of the curvature, which sparse features keep
  small. Two classes share one column of weights, more have one each. It stops when no optimality condition is missed
  by more than the tolerance.
* tree grows level by level. A pass counts, for each open node, the classes of the stored values of each feature by bin;
  zeros enter as the node's totals minus these. The best split of each node is the one that lowers Gini impurity most;
  on ties the smaller feature, then the smaller value. Bins end at values of the feature: at all of them, if there are at
  most `bins`, so splits are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.operators.estimators import added
from glimmer.sources.store import kept

#: Numbers that a batch's products hold at most.
TOGETHER = 1 << 21


def example_rows(codes: DataFrame, labelled: DataFrame, key: str = "example_idx") -> DataFrame:
    """(key, label, at, of) of every labelled example, written out; codes: (key, feature, value), labelled: (key, label)."""
    pairs = codes.where("value <> 0").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("codes"))  # one example's
    none = F.array().cast("array<struct<feature: int, value: double>>")
    rows = labelled.join(pairs, key, "left").withColumn("codes", F.coalesce(F.col("codes").cast("array<struct<feature: int, value: double>>"), none))
    return kept(rows.select(key, F.col("label").cast("int").alias("label"), F.col("codes.feature").alias("at"), F.col("codes.value").alias("of")))


def blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(labels, ends, features, values) of a batch (label, at, of), cut so that a product by `width` stays small."""
    labels, ends = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy().astype(np.int64)
    at, of = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(2).values.to_numpy(zero_copy_only=False)
    start, n = 0, len(labels)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + TOGETHER // width, side="right")) - 1)
        own = slice(int(ends[start]), int(ends[stop]))
        yield labels[start:stop], ends[start : stop + 1] - ends[start], at[own], of[own]
        start = stop


def passed(rows: DataFrame, width: int, local: Callable[..., dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The sums over all blocks of what local(labels, ends, features, values) returns."""

    def of_batch(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
        for block in blocks(batch, width):
            yield local(*block)

    return added(rows.select("label", "at", "of"), of_batch)


def by_row(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sums of each row's values; an empty row's is zero."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return sums[ends[1:]] - sums[ends[:-1]]


@dataclass
class Logistic:
    """weights: (columns, features), one column for two classes; bias: (columns,); missed: the largest amount by which an
    optimality condition of the mean objective is missed; passes over the examples."""

    weights: np.ndarray
    bias: np.ndarray
    missed: float
    passes: int


def residuals(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """The slope of the loss by each score, and the loss, summed."""
    if scores.shape[1] == 1:
        z = scores[:, 0]
        p = 0.5 * (1 + np.tanh(z / 2))
        return (p - labels)[:, None], float((np.logaddexp(0, z) - labels * z).sum())
    top = scores.max(axis=1, keepdims=True)
    e = np.exp(scores - top)
    p = e / e.sum(axis=1, keepdims=True)
    p[np.arange(len(labels)), labels] -= 1
    return p, float((np.log(e.sum(axis=1)) + top[:, 0] - scores[np.arange(len(labels)), labels]).sum())


def l1_logistic(rows: DataFrame, n_features: int, n_classes: int, c: float = 0.01, tolerance: float = 3e-4, most: int = 400) -> Logistic:
    """rows: example_rows(), labels from 0 to n_classes - 1."""
    columns = 1 if n_classes == 2 else n_classes

    def shape(labels: np.ndarray, ends: np.ndarray, at: np.ndarray, of: np.ndarray) -> dict[str, np.ndarray]:
        size = by_row(np.abs(of), ends) + 1  # (x v)^2 <= |x|_1 sum |x_j| v_j^2
        return {"n": np.array([len(labels)]), "curve": np.bincount(at, weights=np.abs(of) * np.repeat(size, np.diff(ends)), minlength=n_features), "base": np.array([size.sum()])}

    found = passed(rows, 1, shape)
    n = float(found["n"][0]) if found else 0.0
    if not n:
        raise ValueError("no examples to learn from")
    bound = 0.25 if columns == 1 else 0.5  # of the curvature of the loss by its scores
    curve = bound * np.append(found["curve"], found["base"]) / n
    rate, penalty = np.where(curve > 0, 1 / np.maximum(curve, 1e-300), 0.0), np.append(np.full(n_features, 1 / (c * n)), 0.0)

    def slope(w: np.ndarray) -> tuple[np.ndarray, float]:
        flat, bias = np.ascontiguousarray(w[:, :-1].T), w[:, -1]

        def local(labels: np.ndarray, ends: np.ndarray, at: np.ndarray, of: np.ndarray) -> dict[str, np.ndarray]:
            left, loss = residuals(by_row(flat[at] * of[:, None], ends) + bias, labels)
            spread = np.repeat(np.arange(len(labels)), np.diff(ends))
            own = np.stack([np.bincount(at, weights=of * left[spread, k], minlength=n_features) for k in range(columns)])
            return {"slope": np.c_[own, left.sum(axis=0)], "loss": np.array([loss])}

        sums = passed(rows, columns, local)
        return sums["slope"] / n, float(sums["loss"][0]) / n

    def missed(w: np.ndarray, g: np.ndarray) -> float:
        """How far zero is from the subgradients."""
        return float(np.where(w != 0, np.abs(g + penalty * np.sign(w)), np.maximum(np.abs(g) - penalty, 0)).max())

    w = ahead = np.zeros((columns, n_features + 1))
    momentum, passes, off = 1.0, 0, np.inf
    while passes < most:
        g, _ = slope(ahead)
        passes += 1
        off = missed(ahead, g)
        if off <= tolerance:
            w = ahead
            break
        step = ahead - rate * g
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        if ((ahead - new) * (new - w)).sum() > 0:  # it overshoots
            momentum = 1.0
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return Logistic(w[:, :-1], w[:, -1], off, passes)


@dataclass
class Node:
    """A split (value <= cut goes to `left`, else to left + 1) or, without one, a leaf; counts: its examples by class."""

    counts: np.ndarray
    feature: int = -1
    cut: float = 0.0
    left: int = -1
    gain: float = 0.0


def gini(counts: np.ndarray) -> np.ndarray:
    """n times the impurity."""
    total = counts.sum(axis=-1)
    return total - (counts**2).sum(axis=-1) / np.maximum(total, 1)


def leaf_of(nodes: list[Node], ends: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    where = np.zeros(len(ends) - 1, dtype=np.int64)
    for number, node in enumerate(nodes):  # children come after their parents
        if node.left < 0:
            continue
        value = np.zeros(len(where))
        mine = at == node.feature
        value[rows[mine]] = of[mine]
        here = where == number
        where[here] = node.left + (value[here] > node.cut)
    return where


def tree(rows: DataFrame, n_features: int, n_classes: int, depth: int = 5, bins: int = 256) -> list[Node]:
    """rows: example_rows(), labels from 0 to n_classes - 1; at most `depth` splits on a way."""
    stored = rows.select(F.explode(F.arrays_zip("at", "of")).alias("x")).select(F.col("x.at").alias("feature"), F.col("x.of").alias("value"))
    values = stored.groupBy("feature", "value").agg(F.count("*").alias("n"))
    # of a feature with few values all of them, of others as many quantiles; at most `bins` numbers a feature reach the driver
    some = F.percentile_approx("value", [(i + 1) / bins for i in range(bins)], 100 * bins)
    cuts = [np.zeros(1)] * n_features
    for r in values.groupBy("feature").agg(some.alias("cuts")).collect():
        cuts[r["feature"]] = np.unique(np.append(r["cuts"], 0.0))
    zero = np.array([int(np.searchsorted(x, 0.0)) for x in cuts])
    total = passed(rows, 1, lambda labels, ends, at, of: {"counts": np.bincount(labels, minlength=n_classes)})
    if not total:
        raise ValueError("no examples to learn from")
    nodes, open_ = [Node(total["counts"])], [0]
    n = nodes[0].counts.sum()
    for _ in range(depth):
        open_ = [i for i in open_ if gini(nodes[i].counts) > 0]
        if not open_:
            break
        sums = rows.select("label", "at", "of").mapInArrow(counter(nodes, open_, cuts), "node int, feature int, bin int, class int, n long").groupBy("node", "feature", "bin", "class").agg(F.sum("n").alias("n"))
        splits = sums.groupBy("feature").applyInArrow(splitter({i: nodes[i].counts for i in open_}, cuts, zero), "node int, feature int, gain double, cut double, left array<double>")
        chosen = splits.groupBy("node").agg(F.max_by(F.struct("feature", "gain", "cut", "left"), F.struct(F.round("gain", 9), -F.col("feature"))).alias("s")).select("node", "s.*").collect()  # one row a node
        open_ = []
        for r in sorted(chosen):
            node, counts = nodes[r["node"]], np.array(r["left"])
            node.feature, node.cut, node.gain, node.left = r["feature"], r["cut"], r["gain"] / n, len(nodes)
            open_ += [len(nodes), len(nodes) + 1]
            nodes += [Node(counts), Node(node.counts - counts)]
    return nodes


def counter(nodes: list[Node], open_: list[int], cuts: list[np.ndarray]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts (node, feature, bin, class, n) of the stored values of the open nodes' rows."""
    names = ["node", "feature", "bin", "class", "n"]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for labels, ends, at, of in blocks(batch, 8):
                leaf = np.repeat(leaf_of(nodes, ends, at, of), np.diff(ends))
                mine = np.isin(leaf, open_)
                leaf, classes, features, values = leaf[mine], np.repeat(labels, np.diff(ends))[mine], at[mine], of[mine]
                place = np.empty(len(values), dtype=np.int64)
                for f in np.unique(features):
                    own = features == f
                    place[own] = np.minimum(np.searchsorted(cuts[f], values[own]), len(cuts[f]) - 1)
                keys, times = np.unique(np.stack([leaf, features, place, classes]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(k.astype(np.int32)) for k in keys), pa.array(times)], names=names)

    return count


def splitter(totals: dict[int, np.ndarray], cuts: list[np.ndarray], zero: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """Of one feature's counts, the best split (node, feature, gain, cut, left) of each node; zeros are what is left of
    the node's totals."""
    kinds = {"node": pa.int32(), "feature": pa.int32(), "gain": pa.float64(), "cut": pa.float64(), "left": pa.list_(pa.float64())}

    def best(table: pa.Table) -> pa.Table:
        feature, out = table["feature"][0].as_py(), []
        node, place, classes, times = (table[c].to_numpy() for c in ("node", "bin", "class", "n"))
        for i in np.unique(node).tolist():
            total, own = totals[i], node == i
            grid = np.zeros((len(cuts[feature]), len(total)))
            np.add.at(grid, (place[own], classes[own]), times[own])
            grid[zero[feature]] += total - grid.sum(axis=0)
            left = np.cumsum(grid, axis=0)[:-1]
            right = total - left
            gains = np.where((left.sum(axis=1) > 0) & (right.sum(axis=1) > 0), gini(total) - gini(left) - gini(right), 0.0)
            if len(gains) and gains.max() > 1e-9:
                at = int(np.flatnonzero(gains >= gains.max() - 1e-9)[0])
                out.append((i, feature, float(gains[at]), float(cuts[feature][at]), left[at].tolist()))
        return pa.table({name: pa.array([x[k] for x in out], type=kind) for k, (name, kind) in enumerate(kinds.items())})

    return best


def predicted(nodes: list[Node], rows: DataFrame, key: str = "example_idx") -> DataFrame:
    """(key, label, predicted): the class that most examples of the leaf had; ties to the smaller one."""
    says = np.array([int(x.counts.argmax()) for x in nodes], dtype=np.int32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.select([1, 2, 3])
            found = [says[leaf_of(nodes, ends, at, of)] for _, ends, at, of in blocks(part, 8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int32))], names=[key, "label", "predicted"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "label", "at", "of").mapInArrow(run, f"{key} {kind}, label int, predicted int")


def importances(model: Logistic | list[Node], n_features: int) -> np.ndarray:
    """Of each feature the sum of absolute weights over classes, or its share of the lowered impurity."""
    if isinstance(model, Logistic):
        return np.abs(model.weights).sum(axis=0)
    sums = np.zeros(n_features)
    for node in model:
        if node.left >= 0:
            sums[node.feature] += node.gain
    return sums / sums.sum() if sums.sum() else sums


def feature_ranking(model: Logistic | list[Node], n_features: int, spark: SparkSession) -> DataFrame:
    """(feature, importance, place), best first; ties to the smaller feature."""
    found = spark.createDataFrame([(i, float(v)) for i, v in enumerate(importances(model, n_features))], "feature int, importance double")
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))  # one row a feature
