"""Incremental statistics over streams. Each micro-batch is reduced to mergeable sums, one row a key."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_stats(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, sum, squares) of a stream, as Spark's own state; use output mode "complete" or "update"."""
    v = F.col(value).cast("double")
    return stream.groupBy(key).agg(F.count(value).alias("n"), F.sum(v).alias("sum"), F.sum(v * v).alias("squares"))


def finished(stats: DataFrame, key: str) -> DataFrame:
    """(key, n, mean, variance) from the sums."""
    n = F.col("n")
    return stats.select(key, "n", (F.col("sum") / n).alias("mean"), F.when(n > 1, (F.col("squares") - F.col("sum") * F.col("sum") / n) / (n - 1)).alias("variance"))


def windowed_counts(stream: DataFrame, ts: str, key: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n) of tumbling windows; state is dropped once the watermark has passed a window."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def since_active(stream: DataFrame, feature: str = "feature", row: str = "row") -> DataFrame:
    """(feature, last, fired) as a stream of updates: the largest row at which each feature fired so far, and how often.
    The state is two numbers a feature."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, fired = state.get if state.exists else (-1, 0)
        for frame in frames:
            last, fired = max(last, int(frame[row].max())), fired + len(frame)
        state.update((last, fired))
        yield pd.DataFrame({feature: [key[0]], "last": [last], "fired": [fired]})

    kind = dict(stream.dtypes)[feature]
    return stream.groupBy(feature).applyInPandasWithState(update, f"{feature} {kind}, last long, fired long", "last long, fired long", "update", GroupStateTimeout.NoTimeout)


def dead_by_state(state: DataFrame, features: DataFrame, n_rows: int, after: int) -> DataFrame:
    """(feature, since, dead) from the state (feature, last, ...) that since_active keeps."""
    since = F.lit(n_rows) - 1 - F.coalesce("last", F.lit(-1))
    return features.join(state, "feature", "left").select("feature", since.cast("long").alias("since"), (since >= after).alias("dead"))


def each_batch(fit: Callable[[object, DataFrame], object], start: object, folder: str | None = None) -> tuple[Callable[[DataFrame, int], None], Callable[[], object]]:
    """For foreachBatch: a function that folds each micro-batch into an estimator, and one that returns it. With a folder
    (shared, reached through Spark) the estimator and the number of the last batch are written after each batch; a query
    that starts again goes on from there and skips a batch that is delivered twice."""
    held: list = [start, -1]

    def load(spark: SparkSession) -> None:
        rows = spark.read.schema("number long, state binary").parquet(f"{folder}/*").orderBy(F.desc("number")).limit(1).collect() if exists(spark) else []
        if rows:
            held[0], held[1] = pickle.loads(rows[0]["state"]), rows[0]["number"]

    def exists(spark: SparkSession) -> bool:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if folder and held[1] < 0:
            load(spark)
        if number <= held[1]:
            return
        held[0], held[1] = fit(held[0], batch), number
        if folder:
            spark.createDataFrame([(number, pickle.dumps(held[0]))], "number long, state binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{number}")

    return fold, lambda: held[0]


def percentile_by_key(df: DataFrame, key: str, order: str, value: str, percent: float, rate: float) -> DataFrame:
    """(key, n, estimate): the stochastic percentile of each key's values in order. Each step depends on the one before,
    so a key's values pass through one task, batch by batch; exact percentiles do not need that."""
    total = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    rows = df.where(F.col(value).isNotNull()).join(F.broadcast(total), key).select(key, order, F.col(value).cast("double").alias("x"), "n")  # one row a key
    dealt = rows.repartition(key).sortWithinPartitions(key, order)
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        for frame in frames:
            for name, own in frame.groupby(key, sort=False):
                if held is None or held[0] != name:
                    if held is not None:
                        yield pd.DataFrame([held[:3]], columns=[key, "n", "estimate"])
                    held = (name, int(own["n"].iloc[0]), 0.0, 0)
                held = (name, held[1], percentile_sgd(own["x"].tolist(), percent, rate, held[1], held[2], held[3]), held[3] + len(own))
        if held is not None:
            yield pd.DataFrame([held[:3]], columns=[key, "n", "estimate"])

    return dealt.mapInPandas(run, f"`{key}` {kind}, n long, estimate double")


def percentile_sgd(values: list[float], percent: float, rate: float, total: int, estimate: float = 0.0, done: int = 0) -> float:
    """A stochastic percentile: steps of falling size towards the side that is short. Order matters; batch percentiles are
    better where all values are at hand. done: steps taken before, which led to the estimate given."""
    for step, x in enumerate(values, done + 1):
        sign = (x > estimate) - (x < estimate)
        estimate += rate * (total - step) / total * (sign + 2 * percent / 100 - 1)
    return estimate


def decayed_fold(values: F.Column, decay: float, start: float) -> F.Column:
    """An exponential moving average over an ordered array column."""
    return F.aggregate(values, F.lit(float(start)), lambda held, x: decay * held + (1 - decay) * x)


def decayed_average(df: DataFrame, order: list[F.Column], value: str, decay: float, start: float = 0.0) -> DataFrame:
    """One row (average): the exponential moving average of a column in a strict order, as one sum: a row enters by its
    place alone, so rows meet in no particular order."""
    from glimmer.operators.relational import ranked

    placed = ranked(df.select(*(c.alias(f"__{i}") for i, c in enumerate(order)), F.col(value).alias("value")), [F.col(f"__{i}") for i in range(len(order))])
    n = df.count()
    back = F.lit(n) - F.col("place")
    return placed.agg((F.coalesce(F.sum((1 - decay) * F.pow(F.lit(decay), back) * F.col("value")), F.lit(0.0)) + start * decay**n).alias("average"))
