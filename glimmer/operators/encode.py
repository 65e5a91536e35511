"""Encoding of vectors into sparse codes, and back. Codes are rows (row, feature, value); zeros are absent."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The largest weights that are broadcast, in bytes.
MOST_WEIGHT_BYTES = 512 << 20
#: Bytes of a dense matrix of rows by features, which a task holds at a time.
MOST_DENSE_BYTES = 64 << 20


@dataclass(frozen=True)
class Weights:
    """enc (features, dims), dec (features, dims), bias_enc (features), bias_dec (dims)."""

    enc: np.ndarray
    dec: np.ndarray
    bias_enc: np.ndarray
    bias_dec: np.ndarray

    def __post_init__(self) -> None:
        if self.enc.nbytes + self.dec.nbytes > MOST_WEIGHT_BYTES:
            raise ValueError(f"weights of over {MOST_WEIGHT_BYTES} bytes are not broadcast")


def mean_vector(acts: DataFrame, act: str = "act") -> np.ndarray:
    """The mean of each dimension, in double; each task sends one row of sums."""
    from glimmer.operators.estimators import summed

    sums = summed(acts, lambda x: {"n": np.array([len(x)]), "s": x.sum(axis=0)}, act)
    return sums["s"] / sums["n"]


def parts_of(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a dense matrix of so many numbers a row takes at most MOST_DENSE_BYTES."""
    each = max(1, MOST_DENSE_BYTES // (8 * width))
    for batch in batches:
        for at in range(0, batch.num_rows, each):
            yield batch.slice(at, each)


def datapoint_weights(acts: DataFrame, n_features: int, row: str = "row", act: str = "act") -> Weights:
    """Tied weights from the first rows: minus the mean vector, at length one; biases are zero."""
    mean = mean_vector(acts, act)
    first = acts.where(F.col(row) < n_features).select(row, act).orderBy(row).collect()  # n_features rows
    dec = np.array([r[act] for r in first], dtype=np.float64) - mean
    dec = dec / np.linalg.norm(dec, axis=1, keepdims=True)
    return Weights(dec, dec, np.zeros(len(dec)), np.zeros(dec.shape[1]))


#: What is kept of a dense matrix of values: name -> function of (values, k, threshold) that returns (rows, features).
TRANSFORMS: dict[str, Callable[[np.ndarray, int, float], tuple[np.ndarray, np.ndarray]]] = {}


def transform(name: str) -> Callable[[Callable], Callable]:
    """Registers a transform under a name."""

    def add(f: Callable[[np.ndarray, int, float], tuple[np.ndarray, np.ndarray]]) -> Callable:
        TRANSFORMS[name] = f
        return f

    return add


@transform("all")
def keep_all(h: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.ones_like(h, dtype=bool))


@transform("positive")
def keep_positive(h: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(h > 0)


@transform("jump")
def keep_jump(h: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(h > max(threshold, 0.0))


@transform("topk")
def keep_topk(h: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of a row, whatever their sign, ties to the smaller feature; zeros are left out."""
    order = np.argsort(-h, axis=1, kind="stable")[:, :k]
    rows, features = np.repeat(np.arange(len(h)), order.shape[1]), order.reshape(-1)
    there = h[rows, features] != 0
    return rows[there], features[there]


def dense_codes(acts: DataFrame, weights: Weights, keep: str = "positive", k: int = 0, threshold: float = 0.0, carry: tuple[str, ...] = ("row",), act: str = "act") -> DataFrame:
    """(carry..., feature, value) by one matrix product for each Arrow batch. keep: the name of a transform; "all" values,
    "positive" ones, "topk" of a row, or "jump", those above max(threshold, 0)."""
    if keep not in TRANSFORMS:
        raise ValueError(f"no transform {keep}; there are {', '.join(sorted(TRANSFORMS))}")
    held, chosen = acts.sparkSession.sparkContext.broadcast((weights.enc.T.copy(), weights.bias_enc)), TRANSFORMS[keep]
    kinds = {f.name: f.dataType.simpleString() for f in acts.schema}
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "feature int", "value double"])
    at = len(carry)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, bias = held.value
        for batch in parts_of(batches, enc.shape[1]):
            x = np.asarray(batch.column(at).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            h = x @ enc + bias
            rows, features = chosen(h, k, threshold)
            taken = [batch.column(i).take(pa.array(rows)) for i in range(at)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(features.astype(np.int32)), pa.array(h[rows, features])], names=[*carry, "feature", "value"])

    return acts.select(*carry, act).mapInArrow(run, ddl)


def batch_topk(codes: DataFrame, k: int, batch_size: int, row: str = "row") -> DataFrame:
    """Of each batch of rows, the k * batch_size largest values; ties to the smaller row and feature."""
    w = Window.partitionBy("batch").orderBy(F.desc("value"), row, "feature")
    return codes.withColumn("batch", F.floor(F.col(row) / batch_size).cast("long")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k * batch_size).drop("rank")


def decode_prefixes(codes: DataFrame, weights: Weights, prefixes: list[int], row: str = "row") -> DataFrame:
    """(row, prefix, x_hat): the sum of value times decoder row over the features below each prefix, plus the bias once.
    Prefixes rise strictly and end with all features. Rows without codes are absent."""
    if prefixes != sorted(set(prefixes)) or prefixes[-1] != len(weights.dec):
        raise ValueError("prefixes must rise strictly and end with all features")
    held = codes.sparkSession.sparkContext.broadcast((weights.dec, weights.bias_dec))
    lists = codes.groupBy(row).agg(F.collect_list(F.struct("feature", "value")).alias("at"))  # one row's codes
    kind = dict(codes.dtypes)[row]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec, bias = held.value
        for batch in parts_of(batches, len(dec)):
            entries = batch.column(1)
            ends = entries.offsets.to_numpy()
            flat = entries.values
            features, values = flat.field("feature").to_numpy(), flat.field("value").to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            features, values = features[ends[0] :][: len(owner)], values[ends[0] :][: len(owner)]
            dense = np.zeros((batch.num_rows, len(dec)))
            np.add.at(dense, (owner, features), values)
            for low, prefix in zip([0, *prefixes], prefixes, strict=False):
                part = dense[:, low:prefix] @ dec[low:prefix]
                total = part + bias if low == 0 else total + part
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, prefix, dtype=np.int32)), pa.array(list(total))], names=[row, "prefix", "x_hat"])

    return lists.mapInArrow(run, f"`{row}` {kind}, prefix int, x_hat array<double>")


def reconstructed(acts: DataFrame, weights: Weights, prefixes: list[int], row: str = "row", act: str = "act") -> DataFrame:
    """(row, prefix, x, x_hat): vectors encoded to positive codes and decoded again in one pass over them, without an
    exchange. A row without codes is rebuilt as the bias."""
    if prefixes != sorted(set(prefixes)) or prefixes[-1] != len(weights.dec):
        raise ValueError("prefixes must rise strictly and end with all features")
    held = acts.sparkSession.sparkContext.broadcast((weights.enc.T.copy(), weights.bias_enc, weights.dec, weights.bias_dec))
    kinds = dict(acts.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, bias_enc, dec, bias_dec = held.value
        for batch in parts_of(batches, len(dec)):
            x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            codes = np.maximum(x @ enc + bias_enc, 0.0)
            total = np.broadcast_to(bias_dec, x.shape)
            for low, prefix in zip([0, *prefixes], prefixes, strict=False):
                total = total + codes[:, low:prefix] @ dec[low:prefix]
                ends = pa.array(np.arange(0, total.size + 1, total.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, prefix, dtype=np.int32)), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(total.reshape(-1)))], names=[row, "prefix", "x", "x_hat"])

    return acts.select(row, act).mapInArrow(run, f"`{row}` {kinds[row]}, prefix int, x {kinds[act]}, x_hat array<double>")


def aux_codes(codes: DataFrame, dead: DataFrame, k: int, row: str = "row") -> DataFrame:
    """Of all values, the k largest positive ones of each row among dead features (feature); ties to the smaller feature.
    What they decode to is held against what the living features leave over."""
    w = Window.partitionBy(row).orderBy(F.desc("value"), "feature")
    own = codes.join(F.broadcast(dead.select("feature")), "feature", "left_semi").where("value > 0")  # one row a feature
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def edited(acts: DataFrame, codes: DataFrame, weights: Weights, feature: int, value: float, row: str = "row", act: str = "act") -> DataFrame:
    """Vectors with one feature set to a value and all else unchanged: x + (value - f) * decoder row."""
    direction = F.array(*(F.lit(float(x)) for x in weights.dec[feature]))
    own = codes.where(F.col("feature") == feature).select(F.col(row), F.col("value").alias("__f"))
    delta = F.lit(value) - F.coalesce("__f", F.lit(0.0))
    return acts.join(own, row, "left").withColumn(act, F.zip_with(F.col(act), direction, lambda x, d: x.cast("double") + delta * d)).drop("__f")


def sampled_prefixes(n_features: int, n_prefixes: int, seed: int, power: float = 0.5) -> list[int]:
    """Prefixes drawn without replacement with Pareto weights, by exponential keys; the last is all features."""
    random = np.random.default_rng(seed)
    sizes = np.arange(1, n_features)
    keys = random.exponential(size=len(sizes)) / sizes.astype(np.float64) ** -(1 + power)
    return sorted([*(sizes[np.argsort(keys)[: n_prefixes - 1]].tolist()), n_features])
