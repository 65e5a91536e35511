"""Estimators on dense vectors: k-means, principal components and semi-negative factorisation.

Each pass is one scan that ends in sums of fixed size (centres by dimensions, dimensions squared, concepts squared);
these are added up in each task, then across tasks in two levels, and solved on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


#: Places in which the sums of tasks meet first.
PLACES = 1024


def added_rows(df: DataFrame, local: Callable[[pa.RecordBatch], Iterable[dict[str, np.ndarray]]]) -> DataFrame:
    """(name, place, shape, sums): the sums, by name, of all arrays that local(batch) yields for the batches of df. Tasks
    send one row a sum; these meet in PLACES places by task, then in one a name, each holding one sum at a time."""
    from pyspark.sql import functions as F

    ddl = "name string, place int, shape array<int>, sums binary"

    def total_of(parts: Iterable[tuple[str, np.ndarray]], place: int) -> pa.RecordBatch:
        total: dict[str, np.ndarray] = {}
        for name, value in parts:
            if name in total:
                total[name] += value
            else:
                total[name] = np.array(value, dtype=np.float64)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), type=pa.string()), pa.array([place] * len(total), type=pa.int32()), pa.array([list(x.shape) for x in total.values()], type=pa.list_(pa.int32())), pa.array([x.tobytes() for x in total.values()], type=pa.binary())],
            names=["name", "place", "shape", "sums"],
        )

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield total_of((x for batch in batches if batch.num_rows for found in local(batch) for x in found.items()), TaskContext.get().partitionId() % PLACES)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield total_of(((name, np.frombuffer(sums).reshape(shape)) for batch in batches for name, _, shape, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True)), 0)

    first = df.mapInArrow(scan, ddl).repartition("name", F.col("place")).mapInArrow(add, ddl)
    return first.repartition("name").mapInArrow(add, ddl)


def added(df: DataFrame, local: Callable[[pa.RecordBatch], Iterable[dict[str, np.ndarray]]]) -> dict[str, np.ndarray]:
    """The same on the driver, which only sums reach."""
    return {r["name"]: np.frombuffer(r["sums"]).reshape(r["shape"]) for r in added_rows(df, local).collect()}


def summed(acts: DataFrame, local: Callable[[np.ndarray], dict[str, np.ndarray]], act: str = "act") -> dict[str, np.ndarray]:
    """The sum over all batches of what local(x) returns; x is (rows, dims) in double."""

    def of_batch(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
        yield local(np.asarray(batch.column(0).flatten(), dtype=np.float64).reshape(batch.num_rows, -1))

    return added(acts.select(act), of_batch)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of and the distance to the nearest centre; ties to the smaller number."""
    squared = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    best = squared.argmin(axis=1)
    return best, np.sqrt(((x - centres[best]) ** 2).sum(axis=1))


def lists(v: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an array of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, max(1, v.shape[1]), dtype=np.int32)), pa.array(np.ascontiguousarray(v).reshape(-1)))


def mapped(acts: DataFrame, carry: tuple[str, ...], names: str, local: Callable[[np.ndarray], list], act: str = "act") -> DataFrame:
    """(carry..., names...) with what local(x) returns for each batch."""
    kinds = {f.name: f.dataType.simpleString() for f in acts.schema}
    labels = [part.split()[0] for part in names.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(len(carry)).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), *(lists(v) if v.ndim > 1 else pa.array(v) for v in local(x))], names=[*carry, *labels])

    return acts.select(*carry, act).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), names]))


@dataclass
class KMeans:
    """centres and the counts behind them. partial_fit moves centres to the weighted mean of what they held and hold; an
    empty centre moves to the farthest vector, and of two centres nearer than `apart` the smaller does."""

    centres: np.ndarray
    counts: np.ndarray = field(default=None)
    apart: float = 0.0

    def __post_init__(self) -> None:
        if self.counts is None:
            self.counts = np.zeros(len(self.centres))

    def assign(self, acts: DataFrame, carry: tuple[str, ...] = ("row",), act: str = "act") -> DataFrame:
        """(carry..., center, distance)."""
        held = self.centres.copy()
        return mapped(acts, carry, "center int, distance double", lambda x: [(r := nearest(x, held))[0].astype(np.int32), r[1]], act)

    def codes(self, acts: DataFrame, carry: tuple[str, ...] = ("row",), act: str = "act") -> DataFrame:
        """(carry..., feature, value): one code a vector, 1 / (1 + distance) at its centre."""
        from pyspark.sql import functions as F

        return self.assign(acts, carry, act).select(*carry, F.col("center").alias("feature"), (1 / (1 + F.col("distance"))).alias("value"))

    def transform(self, acts: DataFrame, carry: tuple[str, ...] = ("row",), act: str = "act") -> DataFrame:
        """(carry..., scores): minus the distance to each centre."""
        held = self.centres.copy()

        def local(x: np.ndarray) -> list:
            squared = (x * x).sum(axis=1)[:, None] - 2 * x @ held.T + (held * held).sum(axis=1)
            return [-np.sqrt(np.maximum(squared, 0))]

        return mapped(acts, carry, "scores array<double>", local, act)

    def rebuilt(self, acts: DataFrame, carry: tuple[str, ...] = ("row",), act: str = "act") -> DataFrame:
        """(carry..., x_hat): the nearest centre."""
        held = self.centres.copy()
        return mapped(acts, carry, "x_hat array<double>", lambda x: [held[nearest(x, held)[0]]], act)

    def partial_fit(self, acts: DataFrame, act: str = "act") -> KMeans:
        held, k = self.centres.copy(), len(self.centres)

        def local(x: np.ndarray) -> dict[str, np.ndarray]:
            best, distance = nearest(x, held)
            sums = np.zeros_like(held)
            np.add.at(sums, best, x)
            return {"sums": sums, "counts": np.bincount(best, minlength=k), "inertia": np.array([(distance**2).sum()])}

        found = summed(acts, local, act)
        now = found.get("counts", np.zeros(k))
        counts = self.counts + now
        centres = np.where(counts[:, None] > 0, (held * self.counts[:, None] + found.get("sums", 0 * held)) / np.maximum(counts, 1)[:, None], held)
        lost = {int(i) for i in np.flatnonzero(counts == 0)}
        if self.apart > 0:
            gaps = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(axis=2), 0))
            for i, j in zip(*np.nonzero(np.triu(gaps < self.apart, 1)), strict=True):
                lost.add(int(i if counts[i] < counts[j] else j))
        if lost:
            from pyspark.sql import functions as F

            far = self.assign(acts, (act,), act).orderBy(F.desc("distance")).limit(len(lost)).collect()
            for i, r in zip(sorted(lost), far, strict=False):
                centres[i], counts[i] = np.array(r[act], dtype=np.float64), 0
        return KMeans(centres, counts, self.apart)

    def evaluate(self, acts: DataFrame, act: str = "act") -> DataFrame:
        """One row: inertia, share of centres in use, mean and largest population."""
        from pyspark.sql import functions as F

        per = self.assign(acts, (), act).groupBy("center").agg(F.count("*").alias("n"), F.sum(F.col("distance") * F.col("distance")).alias("s"))
        return per.agg(F.sum("s").alias("inertia"), (F.count("*") / len(self.centres)).alias("utilisation"), (F.sum("n") / len(self.centres)).alias("mean_population"), F.max("n").alias("max_population"))


@dataclass
class Pca:
    """Running mean and scatter; components are the leading eigenvectors of scatter / (n - 1)."""

    n: float = 0.0
    mean: np.ndarray | None = None
    scatter: np.ndarray | None = None

    def partial_fit(self, acts: DataFrame, act: str = "act") -> Pca:
        """Merges acts in: scatters add up, plus the outer product of the difference of means times n1 n2 / n."""
        found = summed(acts, lambda x: {"n": np.array([len(x)]), "s": x.sum(axis=0), "q": x.T @ x}, act)
        if not found:
            return self
        n, mean = float(found["n"][0]), found["s"] / found["n"][0]
        scatter = found["q"] - n * np.outer(mean, mean)
        if self.n:
            gap, total = mean - self.mean, self.n + n
            scatter = self.scatter + scatter + np.outer(gap, gap) * self.n * n / total
            mean, n = self.mean + gap * n / total, total
        return Pca(n, mean, (scatter + scatter.T) / 2)

    def components(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k leading components as rows, and their shares of variance. Signs make the largest entry positive."""
        values, vectors = np.linalg.eigh(self.scatter / max(1.0, self.n - 1))
        order = np.argsort(-values)[:k]
        rows = vectors[:, order].T
        rows = rows * np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])[:, None]
        return rows, values[order] / max(values.sum(), 1e-300)

    def transform(self, acts: DataFrame, k: int, carry: tuple[str, ...] = ("row",), act: str = "act") -> DataFrame:
        """(carry..., x_hat): vectors rebuilt from k components."""
        rows, mean = self.components(k)[0], self.mean.copy()
        return mapped(acts, carry, "x_hat array<double>", lambda x: [(x - mean) @ rows.T @ rows + mean], act)


def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(x, 0), np.maximum(-x, 0)


@dataclass
class SemiNmf:
    """Non-negative codes z with x about z D. Codes follow from multiplicative updates; the dictionary is solved with a
    ridge from decayed sums of z'z and z'x."""

    dictionary: np.ndarray
    zz: np.ndarray | None = None
    zx: np.ndarray | None = None
    rounds: int = 20
    decay: float = 0.7
    ridge: float = 1e-3

    @staticmethod
    def encode_batch(x: np.ndarray, d: np.ndarray, rounds: int) -> np.ndarray:
        (ap, am), (bp, bm) = parts(x @ d.T), parts(d @ d.T)
        z = np.maximum(x @ d.T, 0) + 1e-3
        for _ in range(rounds):
            z = z * np.sqrt((ap + z @ bm) / (am + z @ bp + 1e-9))
        return z

    def partial_fit(self, acts: DataFrame, act: str = "act") -> SemiNmf:
        d, rounds = self.dictionary.copy(), self.rounds

        def local(x: np.ndarray) -> dict[str, np.ndarray]:
            z = SemiNmf.encode_batch(x, d, rounds)
            return {"zz": z.T @ z, "zx": z.T @ x, "n": np.array([len(x)])}

        found = summed(acts, local, act)
        if not found:
            return self
        zz, zx = found["zz"] / found["n"][0], found["zx"] / found["n"][0]
        if self.zz is not None:
            zz, zx = self.decay * self.zz + (1 - self.decay) * zz, self.decay * self.zx + (1 - self.decay) * zx
        return SemiNmf(np.linalg.solve(zz + self.ridge * np.eye(len(zz)), zx), zz, zx, self.rounds, self.decay, self.ridge)

    def codes(self, acts: DataFrame, carry: tuple[str, ...] = ("row",), act: str = "act") -> DataFrame:
        """(carry..., z)."""
        d, rounds = self.dictionary.copy(), self.rounds
        return mapped(acts, carry, "z array<double>", lambda x: [SemiNmf.encode_batch(x, d, rounds)], act)

    def transform(self, acts: DataFrame, carry: tuple[str, ...] = ("row",), act: str = "act") -> DataFrame:
        """(carry..., x_hat)."""
        d, rounds = self.dictionary.copy(), self.rounds
        return mapped(acts, carry, "x_hat array<double>", lambda x: [SemiNmf.encode_batch(x, d, rounds) @ d], act)


def coherence(weights: np.ndarray, spark) -> DataFrame:
    """One row: the largest absolute inner product of two different rows, and which they are. The dictionary is one
    broadcast matrix; each task takes some of its rows against those behind them."""
    from pyspark.sql import functions as F

    held = spark.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                if i + 1 < len(w):
                    values = np.abs(w[i + 1 :] @ w[i])
                    j = int(values.argmax())
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([i + 1 + j]), pa.array([float(values[j])])], names=["i", "j", "coherence"])

    found = spark.range(len(weights)).mapInArrow(run, "i long, j long, coherence double")
    best = F.max_by(F.struct("i", "j", "coherence"), F.struct(F.col("coherence"), -F.col("i"), -F.col("j"))).alias("b")
    return found.agg(best).select("b.i", "b.j", "b.coherence")
