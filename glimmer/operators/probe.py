"""One-dimensional logistic probes for every pair of feature and class, on sparse codes.

A probe predicts class membership from one feature's value: sigmoid(b + w x). Rows without a code have x = 0 and enter in
closed form, so each pass reads stored values only. A task holds the parameters of a slab of classes as matrices and adds
up gradient and curvature for all probes of the slab, so a stored value is no row for each class; a slab has as many
classes as SLAB_BYTES allow, and each slab is a scan. Damped Newton steps are column expressions. Parameters are written
out after each pass; plans do not grow.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.functions.columns import clip, harmonic, sigmoid, softplus
from glimmer.operators.estimators import added_rows
from glimmer.operators.ordered import running

RIDGE = 1e-8
#: The most that a step moves a probe by.
RADIUS = 6.0


def priors(n_positive: DataFrame, n_rows: int) -> DataFrame:
    """(class, total, mean, b0)."""
    mean = F.col("total") / n_rows
    p = clip(mean, 1e-12, 1 - 1e-12)
    return n_positive.select("class", "total", mean.alias("mean"), F.log(p / (1 - p)).alias("b0"))


def start(features: DataFrame, base: DataFrame) -> DataFrame:
    """(feature, class, b, w, damping) with b at the prior and w = 0."""
    return features.select("feature").crossJoin(F.broadcast(base)).select("feature", "class", F.col("b0").alias("b"), F.lit(0.0).alias("w"), F.lit(1e-3).alias("damping"))


#: Bytes of a task's sums for a slab of classes.
SLAB_BYTES = 64 << 20
#: What is added up for each feature and class, and the features of one row of sums.
SUMS = ("nnz", "pos", "mu", "g1", "h0", "h1", "h2", "bce")
BLOCK = 256


def slab_sums(own: DataFrame, params: dict[str, np.ndarray], classes: np.ndarray) -> DataFrame:
    """(feature, class, SUMS...) of the stored values own (feature, value, true) under the parameters of some classes;
    params: features, ascending, with b and w (features, classes)."""
    features, b, w = params["features"], params["b"], params["w"]

    def local(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
        each = max(1, (4 << 20) // (8 * len(SUMS) * len(classes)))
        for start in range(0, batch.num_rows, each):
            part = batch.slice(start, each)
            at = np.searchsorted(features, part.column(0).to_numpy(zero_copy_only=False))
            order = np.argsort(at, kind="stable")
            at, x = at[order], part.column(1).to_numpy(zero_copy_only=False)[order][:, None]
            y = (part.column(2).fill_null(-1).to_numpy(zero_copy_only=False)[order][:, None] == classes).astype(np.float64)
            z = b[at] + w[at] * x
            mu = 0.5 * (1 + np.tanh(z / 2))
            s = mu * (1 - mu)
            terms = np.stack([np.ones_like(z), y, mu, (mu - y) * x, s, s * x, s * x * x, np.logaddexp(0, z) - y * z], axis=1)
            firsts = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1]
            sums, found = np.add.reduceat(terms, firsts, axis=0), at[firsts]
            for block in np.unique(found // BLOCK).tolist():
                mine = found // BLOCK == block
                total = np.zeros((min(BLOCK, len(features) - block * BLOCK), len(SUMS), len(classes)))
                total[found[mine] - block * BLOCK] = sums[mine]
                yield {str(block): total}

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, shape, sums in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                total = np.frombuffer(sums).reshape(shape)
                some = np.flatnonzero(total[:, 0, 0] > 0)
                own = features[int(name) * BLOCK + some]
                columns = [pa.array(np.repeat(own, len(classes)).astype(np.int32)), pa.array(np.tile(classes, len(some)).astype(np.int32))]
                columns += [pa.array(total[some, i].reshape(-1)) for i in range(len(SUMS))]
                yield pa.RecordBatch.from_arrays(columns, names=["feature", "class", *SUMS])

    return added_rows(own, local).mapInArrow(spread, ", ".join(["feature int", "class int", *(f"{c} double" for c in SUMS)]))


def labelled(codes: DataFrame, labels: DataFrame) -> DataFrame:
    """(feature, value, true): the stored values with the classes of their rows. labels: (row, class) of positive rows."""
    return codes.select("row", "feature", "value").join(labels.select("row", F.col("class").cast("int").alias("true")), "row", "left").select(F.col("feature").cast("int").alias("feature"), F.col("value").cast("double").alias("value"), "true")


def probe_stats(codes: DataFrame, labels: DataFrame, params: DataFrame, base: DataFrame, n_rows: int) -> DataFrame:
    """(feature, class, g0, g1, h0, h1, h2, loss): means over all rows of gradient and curvature, and of the loss.

    labels: (row, class) of positive rows; params: of every feature and class, small enough to be sent to every task."""
    return stats_of(labelled(codes, labels), params, base, n_rows)


def stats_of(own: DataFrame, params: DataFrame, base: DataFrame, n_rows: int) -> DataFrame:
    """The same from labelled codes."""
    told = params.select("feature", "class", "b", "w").toArrow().sort_by([("feature", "ascending"), ("class", "ascending")])
    features, classes = (np.unique(told[c].to_numpy()) for c in ("feature", "class"))
    if len(told) != len(features) * len(classes):
        raise ValueError("a probe lacks its parameters")
    b, w = (told[c].to_numpy().reshape(len(features), len(classes)) for c in ("b", "w"))
    own = own.where(F.col("feature").isin(features.tolist())) if len(features) < 1000 else own.join(params.select("feature").distinct(), "feature", "left_semi")
    each = max(1, SLAB_BYTES // (8 * len(SUMS) * max(1, len(features))))
    sums = None
    for start in range(0, len(classes), each):
        slab = slab_sums(own, {"features": features, "b": b[:, start : start + each], "w": w[:, start : start + each]}, classes[start : start + each])
        sums = slab if sums is None else sums.unionByName(slab)
    full = params.join(sums, ["feature", "class"], "left").join(F.broadcast(base), "class")
    zero: dict[str, Column] = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in SUMS[1:]}
    rest = (F.lit(n_rows) - F.coalesce("nnz", F.lit(0.0))) / n_rows
    at_zero = sigmoid(F.col("b"))
    away = F.col("b") - F.col("b0")
    lost = F.col("total") - zero["pos"]
    return full.select(
        "feature", "class", "b", "w", "damping", "nnz",
        (zero["mu"] / n_rows + rest * at_zero - F.col("mean") + RIDGE * away).alias("g0"),
        (zero["g1"] / n_rows + RIDGE * F.col("w")).alias("g1"),
        (zero["h0"] / n_rows + rest * at_zero * (1 - at_zero) + RIDGE).alias("h0"),
        (zero["h1"] / n_rows).alias("h1"),
        (zero["h2"] / n_rows + RIDGE).alias("h2"),
        ((zero["bce"] + lost * softplus(-F.col("b")) + (rest * n_rows - lost) * softplus(F.col("b"))) / n_rows).alias("loss"),
    )


def stepped(stats: DataFrame, scale: DataFrame, radius: float) -> DataFrame:
    """stats with nb and nw, where a step leads to."""
    d, q2 = F.col("damping"), F.col("qx") * F.col("qx")
    a, c = F.col("h0") + d, F.col("h2") + d * q2
    det = a * c - F.col("h1") * F.col("h1")
    db, dw = (c * F.col("g0") - F.col("h1") * F.col("g1")) / det, (a * F.col("g1") - F.col("h1") * F.col("g0")) / det
    moved = stats.join(F.broadcast(scale), "feature").withColumns({"db": db, "dw": dw})
    size = F.sqrt(F.col("db") * F.col("db") + q2 * F.col("dw") * F.col("dw"))
    shrink = F.when(size > radius, radius / size).otherwise(F.lit(1.0))
    some = F.col("nnz").isNotNull()
    return moved.select(*stats.columns, F.when(some, F.col("b") - shrink * F.col("db")).otherwise(F.col("b")).alias("nb"), F.when(some, F.col("w") - shrink * F.col("dw")).otherwise(F.col("w")).alias("nw"))


def step(stats: DataFrame, scale: DataFrame, radius: float = RADIUS) -> DataFrame:
    """(feature, class, b, w, loss, damping): one damped Newton step, at most `radius` long in (b, qx w). A feature
    without values keeps its start. scale: (feature, qx)."""
    return stepped(stats, scale, radius).select("feature", "class", F.col("nb").alias("b"), F.col("nw").alias("w"), "loss", "damping")


def fit_probes(codes: DataFrame, labels: DataFrame, features: DataFrame, base: DataFrame, scale: DataFrame, n_rows: int, passes: int, folder: str) -> DataFrame:
    """(feature, class, b, w, loss): so many steps. A step that made a probe's loss worse is taken back and its damping
    raised tenfold; a good one lowers it. Parameters of each pass are a table below `folder`, in shared storage. Codes meet
    their labels once, before the passes, and so are the priors and scales made; a pass is one scan of the labelled codes."""
    spark = codes.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = f"{folder}/probes-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    own, base, scale = written(labelled(codes, labels)), written(base), written(scale)
    best = written(start(features, base).withColumns({"best_b": F.col("b"), "best_w": F.col("w"), "best": F.lit(float("inf"))}))
    for turn in range(passes + 1):
        stats = stats_of(own, best.select("feature", "class", "b", "w", "damping"), base, n_rows)
        joined = stats.join(best.select("feature", "class", "best_b", "best_w", "best"), ["feature", "class"])
        good = F.col("loss") <= F.col("best")
        kept = joined.select(
            "feature", "class", "nnz", "g0", "g1", "h0", "h1", "h2", "loss", good.alias("good"),
            F.col("b"), F.col("w"), F.when(good, F.col("b")).otherwise(F.col("best_b")).alias("best_b"), F.when(good, F.col("w")).otherwise(F.col("best_w")).alias("best_w"), F.least("loss", "best").alias("best"),
            clip(F.when(good, F.col("damping") * 0.3).otherwise(F.col("damping") * 10), 1e-12, 1e12).alias("damping"),
        )
        kept = written(kept)
        if turn == passes:
            break
        after = stepped(kept, scale, RADIUS)
        # a bad step goes halfway back to the best point instead of on from a worse one; worked out from the table at each use
        best = after.select("feature", "class", "damping", "best_b", "best_w", "best", F.when(F.col("good"), F.col("nb")).otherwise((F.col("b") + F.col("best_b")) / 2).alias("b"), F.when(F.col("good"), F.col("nw")).otherwise((F.col("w") + F.col("best_w")) / 2).alias("w"))
    return kept.select("feature", "class", F.col("best_b").alias("b"), F.col("best_w").alias("w"), F.col("best").alias("loss"))


def probe_confusion(codes: DataFrame, labels: DataFrame, params: DataFrame, base: DataFrame, n_rows: int, tau: float) -> DataFrame:
    """(feature, class, tp, fp, tn, fn) of "probability > tau"; absent values are all on one side."""
    own = codes.select("row", "feature", "value").join(labels.select("row", F.col("class").alias("true")), "row", "left")
    says = sigmoid(F.col("b") + F.col("w") * F.col("value")) > tau
    is_class = F.coalesce(F.col("true") == F.col("class"), F.lit(False))
    sums = own.join(params.select("feature", "class", "b", "w"), "feature").groupBy("feature", "class").agg(F.count("*").alias("nnz"), F.count_if(is_class).alias("pos"), F.count_if(says & is_class).alias("a"), F.count_if(says & ~is_class).alias("c"))
    full = params.join(sums, ["feature", "class"], "left").join(F.broadcast(base), "class").fillna(0, ["nnz", "pos", "a", "c"])
    lost, rest = F.col("total") - F.col("pos"), F.lit(n_rows) - F.col("nnz") - F.col("total") + F.col("pos")
    on = F.when(sigmoid(F.col("b")) > tau, 1).otherwise(0)
    tp, fp = F.col("a") + on * lost, F.col("c") + on * rest
    return full.select("feature", "class", tp.alias("tp"), fp.alias("fp"), (F.lit(n_rows) - F.col("total") - fp).alias("tn"), (F.col("total") - tp).alias("fn"))


def best_probes(params: DataFrame) -> DataFrame:
    """(class, feature, b, w, loss) of each class's probe with the least training loss; ties to the smaller feature."""
    return params.groupBy("class").agg(F.min_by(F.struct("feature", "b", "w", "loss"), F.struct(F.round("loss", 9), F.col("feature"))).alias("p")).select("class", "p.*")


def held_out_metrics(codes: DataFrame, labels: DataFrame, best: DataFrame, n_rows: int) -> DataFrame:
    """(class, feature, n_positive, ap, precision, recall, f1) of one probe a class on other rows than it was fitted on:
    average precision of the scores b + w x, and the counts at a score over the class's cut (0 if best has none). Rows
    without a code have the score b, one group of ties that a negative weight puts above stored values. Tied scores count
    by the mean over their orders; classes without positive rows get zeros. labels: (row, class); best: (class, feature,
    b, w) and perhaps cut."""
    if "cut" not in best.columns:
        best = best.withColumn("cut", F.lit(0.0))
    own = codes.select("row", "feature", "value").join(F.broadcast(best.select("class", "feature", "b", "w")), "feature")  # a row a class
    own = own.join(labels.select("row", F.col("class").alias("true")), "row")
    scored = own.select("class", (F.col("w") * F.col("value")).alias("value"), (F.col("true") == F.col("class")).cast("long").alias("y"))
    stored = scored.groupBy("class", "value").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    totals = best.select("class").join(labels.groupBy("class").agg(F.count("*").alias("total")), "class", "left").fillna(0)
    rest = totals.join(stored.groupBy("class").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")), "class", "left").fillna(0)
    rest = rest.select("class", F.lit(0.0).alias("value"), (F.lit(n_rows) - F.col("n")).alias("n"), (F.col("total") - F.col("pos")).alias("pos"))
    every = stored.unionByName(rest).groupBy("class", F.when(F.col("value") == 0, 0.0).otherwise(F.col("value")).alias("value")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where("n > 0")  # -0.0 is 0.0
    groups = running(every, ["class"], [F.desc("value")], {"t": F.col("n"), "r0": F.col("pos")})
    slope = F.when(F.col("n") > 1, (F.col("pos") - 1) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    t, n = F.col("t").cast("double"), F.col("n").cast("double")
    ranks = harmonic(t + n) - harmonic(t)
    part = F.when(F.col("pos") > 0, F.col("pos") / n * ((F.col("r0") + 1 - (t + 1) * slope) * ranks + slope * n)).otherwise(F.lit(0.0))
    on = F.col("value") + F.col("b") > F.col("cut")
    found = groups.join(F.broadcast(best.select("class", "feature", "b", "cut")), "class").groupBy("class", "feature").agg(F.sum(part).alias("sum"), F.sum("pos").alias("total"), F.sum(F.when(on, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(on, F.col("n")).otherwise(0)).alias("said"))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    tp, said, total = F.col("tp"), F.col("said"), F.col("total")
    return found.select("class", "feature", total.alias("n_positive"), share(F.col("sum"), total).alias("ap"), share(tp, said).alias("precision"), share(tp, total).alias("recall"), share(2 * tp, said + total).alias("f1"))


def checked_side(codes: DataFrame, labels: DataFrame, n_rows: int, n_features: int, n_classes: int | None = None) -> int:
    """Checks what a probe is fitted on or judged by, and returns the classes: the largest label plus one. labels, a
    relation of its own (row, label), must hold each of the rows 0 to n_rows - 1 once; codes must lie within the rows and
    features; labels may not reach beyond n_classes, the classes of the training side."""
    got = labels.agg(F.count("*").alias("n"), F.count_distinct("row").alias("different"), F.min("row").alias("first"), F.max("row").alias("last"), F.max("label").alias("most"), F.min("label").alias("least"), F.count("label").alias("given")).first()
    seen = codes.agg(F.max("row").alias("row"), F.min("row").alias("first"), F.max("feature").alias("feature")).first()
    if got["n"] != n_rows or got["different"] != n_rows or n_rows and (got["first"], got["last"]) != (0, n_rows - 1):
        raise ValueError(f"{got['n']} labels, {got['different']} different, from {got['first']} to {got['last']}, for {n_rows} rows")
    if got["given"] != got["n"] or (got["least"] or 0) < 0:
        raise ValueError("a label is missing or negative")
    if seen["row"] is not None and (seen["row"] >= n_rows or seen["first"] < 0 or seen["feature"] >= n_features):
        raise ValueError(f"codes reach row {seen['row']} and feature {seen['feature']} of {n_rows} and {n_features}")
    classes = (got["most"] if got["most"] is not None else -1) + 1
    if n_classes is not None and classes > n_classes:
        raise ValueError(f"labels reach class {classes - 1}, but {n_classes} classes were fitted")
    return classes if n_classes is None else n_classes
