"""Baselines: families of models by name, a training loop that can be stopped and resumed, and inference by family.

A batch of the shuffled scan is a folder of its own, so a step reads its batch only. After each step the model and the
number of the next batch are one file in the run's folder, written under a temporary name; the two newest stay. A run
that starts again goes on from the newest, with the same result as one that was never stopped.
"""

from __future__ import annotations

import io
from collections.abc import Callable
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.operators import estimators, stats
from glimmer.plans.catalog import query, r6
from glimmer.plans.relations import Relations
from glimmer.sources import store
from glimmer.sources.shards import store_of


@dataclass(frozen=True)
class Family:
    """kind: the estimator's class, whose fields are its state; start: an untrained one from some vectors; codes: (row,
    feature, value), without zeros; rebuilt: (row, x_hat)."""

    kind: type
    start: Callable[[np.ndarray], object]
    codes: Callable[[object, DataFrame], DataFrame]
    rebuilt: Callable[[object, DataFrame], DataFrame]


def exploded(rows: DataFrame, values: str) -> DataFrame:
    """(row, feature, value) of the numbers of an array that are not zero."""
    return rows.select("row", F.posexplode(values).alias("feature", "value")).where("value <> 0")


def pca_codes(model: estimators.Pca, acts: DataFrame, k: int) -> DataFrame:
    rows, mean = model.components(k)[0], model.mean.copy()
    return exploded(estimators.mapped(acts, ("row",), "z array<double>", lambda x: [(x - mean) @ rows.T]), "z")


#: Components that are kept of a family that has more.
KEPT = 8

FAMILIES = {
    "kmeans": Family(estimators.KMeans, lambda x: estimators.KMeans(x), lambda m, acts: m.codes(acts), lambda m, acts: m.rebuilt(acts)),
    "pca": Family(estimators.Pca, lambda x: estimators.Pca(), lambda m, acts: pca_codes(m, acts, KEPT), lambda m, acts: m.transform(acts, KEPT)),
    "semi_nmf": Family(estimators.SemiNmf, lambda x: estimators.SemiNmf(x), lambda m, acts: exploded(m.codes(acts), "z"), lambda m, acts: m.transform(acts)),
}


def family(name: str) -> Family:
    if name not in FAMILIES:
        raise ValueError(f"no family {name}; there are {', '.join(FAMILIES)}")
    return FAMILIES[name]


def state_of(model: object, position: int) -> bytes:
    out = io.BytesIO()
    np.savez(out, __position=position, **{f.name: np.asarray(getattr(model, f.name)) for f in fields(model) if getattr(model, f.name) is not None})
    return out.getvalue()


def model_of(name: str, content: bytes) -> tuple[object, int]:
    """(model, next batch)."""
    with np.load(io.BytesIO(content), allow_pickle=False) as found:
        arrays = {k: found[k].item() if found[k].ndim == 0 else found[k] for k in found.files}
    position = arrays.pop("__position")
    return family(name).kind(**arrays), position


class Run:
    """The states of a run in a folder."""

    def __init__(self, name: str, folder: str) -> None:
        self.name, (self.store, self.top) = name, store_of(folder)
        self.store.create_dir(self.top)

    def states(self) -> list[str]:
        from pyarrow import fs

        return sorted(i.path for i in self.store.get_file_info(fs.FileSelector(self.top)) if i.base_name.startswith(f"{self.name}-") and i.base_name.endswith(".npz"))

    def load(self) -> tuple[object, int] | None:
        paths = self.states()
        if not paths:
            return None
        with self.store.open_input_stream(paths[-1]) as file:
            return model_of(self.name, file.read())

    def save(self, model: object, position: int) -> None:
        path = f"{self.top}/{self.name}-{position:08d}.npz"
        with self.store.open_output_stream(f"{path}.part", compression=None) as out:
            out.write(state_of(model, position))
        self.store.move(f"{path}.part", path)
        for old in self.states()[:-2]:
            self.store.delete_file(old)


def shuffled_batches(acts: DataFrame, seed: int, n_batches: int) -> str:
    """The path of a shuffled table, a folder for each batch."""
    path = store.scratch(acts.sparkSession, "batches")
    number = F.expr(f"pmod(conv(substring(shuffle_key, 1, 8), 16, 10), {n_batches})").cast("int")
    store.shuffled_scan(acts, seed, ["row"]).withColumn("batch", number).write.partitionBy("batch").parquet(path)
    return path


def trained(name: str, acts: DataFrame, batches: str, n_batches: int, start: np.ndarray, folder: str, until: int | None = None) -> object:
    """The model after all batches, or after those before `until`. acts: what the batches were made of."""
    run, spark = Run(name, folder), acts.sparkSession
    model, position = run.load() or (family(name).start(start.copy()), 0)
    for number in range(position, n_batches if until is None else min(until, n_batches)):
        own = spark.read.schema(f"act {acts.schema['act'].dataType.simpleString()}, batch int").parquet(batches).where(F.col("batch") == number).select("act")
        model = model.partial_fit(own)
        run.save(model, number + 1)
    return model


def measured(name: str, model: object, acts: DataFrame) -> DataFrame:
    """(nmse, mse_per_dim, l0) of a model on some vectors (row, act)."""
    pairs = family(name).rebuilt(model, acts).join(acts.select("row", F.col("act").alias("x")), "row")
    n = family(name).codes(model, acts).agg(F.count("*").alias("codes"))
    return stats.recon_metrics(pairs).crossJoin(n).select("nmse", "mse_per_dim", (F.col("codes") / F.col("n_tokens")).alias("l0"))  # one row each


@query
def baseline_methods(r: Relations) -> DataFrame:
    """Each family trained on four batches of the shuffled scan, and its errors and codes a vector on all vectors."""
    batches, folder = shuffled_batches(r.acts.select("row", "act"), 5, 4), store.scratch(r.spark, "baselines")
    acts, out = r.acts.select("row", "act"), None
    for name in FAMILIES:
        model = trained(name, acts, batches, 4, r.weights.dec[:KEPT], folder)
        found = measured(name, model, acts).select(F.lit(name).alias("method"), r6("nmse"), r6("mse_per_dim"), r6("l0"))
        out = found if out is None else out.unionByName(found)
    return out
