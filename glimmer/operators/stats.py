"""Summaries: reconstruction, sparsity, entropy, modes, accuracy, overlap and interventions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.operators.ranking import exact_quantiles


def pair_sums(pairs: DataFrame, x: str, x_hat: str) -> DataFrame:
    """One row of sums over rows of (x, x_hat) arrays: n, and by dimension s and q (of x and its square), e and d (of the
    squared and the plain difference). Each task sends one row."""
    names = ("s", "q", "e", "d")
    ddl = ", ".join(["n long", *(f"{c} array<double>" for c in names)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                a, b = (np.asarray(part.column(i).flatten(), dtype=np.float64).reshape(part.num_rows, -1) for i in (0, 1))
                sums = np.stack([a.sum(axis=0), (a * a).sum(axis=0), ((a - b) ** 2).sum(axis=0), (a - b).sum(axis=0)])
                n, total = n + part.num_rows, sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([x.tolist()], type=pa.list_(pa.float64())) for x in total)], names=["n", *names])

    parts = pairs.select(x, x_hat).mapInArrow(run, ddl)
    flat = parts.select("n", F.posexplode(F.arrays_zip(*names)).alias("at", "z")).groupBy("at").agg(F.sum("n").alias("n"), *(F.sum(f"z.{c}").alias(c) for c in names))
    return flat.agg(F.max("n").alias("n"), F.count("*").alias("d_model"), F.sum("e").alias("e"), F.sum("q").alias("q"), F.sum("s").alias("s"), F.sum("d").alias("d"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("means"))


def recon_metrics(pairs: DataFrame, x: str = "x", x_hat: str = "x_hat") -> DataFrame:
    """One row from rows of (x, x_hat) arrays: n_tokens, d_model, sse_recon, sse_baseline (about the mean vector), nmse
    and errors a token and a number. nmse is null where the baseline is not positive."""
    total = pair_sums(pairs, x, x_hat).select(F.col("n").alias("n_tokens"), "d_model", F.col("e").alias("sse_recon"), (F.col("q") - F.col("means")).alias("sse_baseline"))
    per = F.col("n_tokens") * F.col("d_model")
    return total.select(
        "n_tokens", "d_model", "sse_recon", "sse_baseline", F.when(F.col("sse_baseline") > 0, F.col("sse_recon") / F.col("sse_baseline")).alias("nmse"),
        (F.col("sse_recon") / per).alias("mse_per_dim"), (F.col("sse_recon") / F.col("n_tokens")).alias("mse_per_token"), (F.col("sse_baseline") / per).alias("baseline_per_dim"), (F.col("sse_baseline") / F.col("n_tokens")).alias("baseline_per_token"),
    )


def explained_variance(pairs: DataFrame, x: str = "x", x_hat: str = "x_hat") -> DataFrame:
    """One row: 1 - var(x - x_hat) / var(x) over all numbers of the arrays, with sample variances."""
    n = F.col("n") * F.col("d_model")
    found = pair_sums(pairs, x, x_hat).select(((F.col("e") - F.col("d") * F.col("d") / n) / (n - 1)).alias("r"), ((F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)).alias("v"))
    return found.select(F.when(F.col("v") > 0, 1 - F.col("r") / F.col("v")).alias("explained"))


def eval_summary(codes: DataFrame, stats: DataFrame, n_tokens: int) -> DataFrame:
    """One row: mean L0 and L1 of a token, and how many features are dead, almost dead or dense."""
    sums = codes.agg(F.count_if(F.col("value") != 0).alias("l0"), F.coalesce(F.sum(F.abs("value")), F.lit(0.0)).alias("l1"))
    freq = stats.agg(F.count_if(F.col("sparsity") == 0).alias("n_dead"), F.count_if(F.col("sparsity") < 1e-7).alias("n_almost_dead"), F.count_if(F.col("sparsity") > 1e-2).alias("n_dense"))
    return sums.crossJoin(freq).select((F.col("l0") / n_tokens).alias("l0"), (F.col("l1") / n_tokens).alias("l1"), "n_dead", "n_almost_dead", "n_dense")  # one row each


def key_entropy(df: DataFrame, key: str, support: int) -> DataFrame:
    """One row: entropy of the key's distribution, the same as a share of ln(support), and the share of keys seen."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.log("t") - F.col("s") / F.col("t")
    scaled = F.when(F.lit(support) > 1, entropy / F.log(F.lit(float(support)))).otherwise(F.lit(0.0))
    return total.select(entropy.alias("entropy"), scaled.alias("normalised"), (F.col("k") / support).alias("coverage"))


def label_entropy(active: DataFrame, features: DataFrame, n_classes: int) -> DataFrame:
    """(feature, support, entropy, concentration) of the labels among rows (feature, label); null without rows."""
    counts = active.groupBy("feature", "label").agg(F.count("*").alias("n"))
    got = counts.groupBy("feature").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.log("t") - F.col("s") / F.col("t")
    return features.join(got, "feature", "left").select("feature", F.coalesce("t", F.lit(0)).cast("long").alias("support"), entropy.alias("entropy"), (1 - entropy / F.log(F.lit(float(n_classes)))).alias("concentration"))


def modal_label(df: DataFrame, by: list[str], label: str = "label", background: int | None = None) -> DataFrame:
    """(by..., label, n): the most frequent label, ties to the smaller. With a background, it only wins alone."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    best = F.struct(F.col("n").alias("n"), (-F.col(label)).alias("minus"))
    if background is None:
        out = F.max(best)
    else:
        out = F.coalesce(F.max(F.when(F.col(label) != background, best)), F.max(best))
    return counts.groupBy(*by).agg(out.alias("b")).select(*by, (-F.col("b.minus")).alias(label), F.col("b.n").alias("n"))


def modal_share(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """(by..., label, share): the modal label and its share."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.col("n").alias("n"), (-F.col(label)).alias("minus")))
    return counts.groupBy(*by).agg(best.alias("b"), F.sum("n").alias("t")).select(*by, (-F.col("b.minus")).alias(label), (F.col("b.n") / F.col("t")).alias("share"))


def pure_counts(patches: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(label, n) of patches whose modal label has at least the share, for all classes."""
    got = patches.where(F.col("share") >= threshold).groupBy("label").agg(F.count("*").alias("n"))
    return classes.join(got, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_iou(df: DataFrame, classes: DataFrame, model: str = "model", pred: str = "pred", true: str = "label", ignored: int | None = None) -> DataFrame:
    """(model, label, iou): rows where both say the class over rows where either does; null for an absent class."""
    sides = df.select(F.col(model), F.explode(F.array_distinct(F.array(pred, true))).alias("label"), (F.col(pred) == F.col(true)).cast("int").alias("both"))
    got = sides.groupBy(model, "label").agg(F.sum("both").alias("i"), F.count("*").alias("u"))
    wanted = df.select(model).distinct().crossJoin(F.broadcast(classes.where(F.col("label") != ignored) if ignored is not None else classes))  # models x classes
    return wanted.join(got, [model, "label"], "left").select(model, "label", F.when(F.col("u") > 0, F.col("i") / F.col("u")).alias("iou"))


def accuracies(df: DataFrame, by: list[str], pred: str = "pred", true: str = "label") -> DataFrame:
    """(by..., accuracy, balanced, majority): over rows, mean over classes of the share that is right, and the share of
    the largest class."""
    per_class = df.groupBy(*by, true).agg(F.count("*").alias("n"), F.sum((F.col(pred) == F.col(true)).cast("int")).alias("r"))
    return per_class.groupBy(*by).agg((F.sum("r") / F.sum("n")).alias("accuracy"), F.avg(F.col("r") / F.col("n")).alias("balanced"), (F.max("n") / F.sum("n")).alias("majority"))


def intervention_report(df: DataFrame, target: int, before: str = "before", after: str = "after") -> DataFrame:
    """One row: the share of predictions that an edit changes, of the target class and, as mean and standard deviation
    over classes, of the others; and where the target's changed ones go."""
    per_class = df.groupBy(before).agg(F.count("*").alias("n"), F.sum((F.col(before) != F.col(after)).cast("int")).alias("c"))
    share = F.col("c") / F.col("n")
    rates = per_class.agg(F.max(F.when(F.col(before) == target, share)).alias("target_changed"), F.avg(F.when(F.col(before) != target, share)).alias("other_changed"), F.stddev_pop(F.when(F.col(before) != target, share)).alias("other_std"))
    moved = df.where((F.col(before) == target) & (F.col(after) != target)).groupBy(after).agg(F.count("*").alias("n"))
    went = moved.agg(F.array_sort(F.collect_list(F.struct(F.col(after).alias("label"), "n"))).alias("went"))  # at most one entry a class
    return rates.crossJoin(went)  # one row each


def probe_r(train: DataFrame, base: DataFrame) -> DataFrame:
    """One row: 1 - mean cross-entropy of each class's best latent over the mean of its prior. train: (class, ce) of the
    best latent; base: (class, p)."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    ce0 = -(p * F.log(p) + (1 - p) * F.log(1 - p))
    return train.join(base.select("class", ce0.alias("ce0")), "class").agg((1 - F.avg("ce") / F.avg("ce0")).alias("probe_r"))


def quantiles(df: DataFrame, by: list[str], value: str, at: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """(by..., n, mean, std, min, max, q...): exact quantiles with linear interpolation."""
    plain = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    found = exact_quantiles(df, by, value, list(at))
    return plain.join(found, by, "left").select(*by, "n", "mean", "std", "min", "max", *(F.col(f"q{i}").alias(f"q{round(100 * q):02d}") for i, q in enumerate(at)))


def expected_bytes(n_examples: Column | int, tokens: int, layers: int, dims: int) -> Column:
    """Of a store of float32 vectors."""
    return (F.lit(n_examples) if isinstance(n_examples, int) else n_examples) * tokens * layers * dims * 4


#: Of a record of reconstruction metrics: whole numbers, other numbers, and which ratio each derived one is.
WHOLE = ("n_tokens", "d_model", "n_elements")
RATIOS = {
    "mse_per_dim": ("sse_recon", "n_elements"), "mse_per_token": ("sse_recon", "n_tokens"), "normalized_mse": ("sse_recon", "sse_baseline"),
    "baseline_mse_per_dim": ("sse_baseline", "n_elements"), "baseline_mse_per_token": ("sse_baseline", "n_tokens"),
}
SUMS = ("sse_recon", "sse_baseline")


def strict_metrics(df: DataFrame, text: str) -> DataFrame:
    """df with the fields of a JSON record of metrics and `reason`, null if it is good. A whole number is one written
    without a fraction; true and false are no numbers; null is missing. A good record has positive sizes that fit each
    other, finite numbers, a non-negative error, a positive baseline, and ratios that follow from its sums (to 1e-9).
    Fields of bad records are null where they can't be read."""
    held = F.try_parse_json(F.col(text))
    names = [*WHOLE, *SUMS, *RATIOS]
    kinds = {n: F.schema_of_variant(F.try_variant_get(held, f"$.{n}", "variant")) for n in names}
    values = {n: F.try_variant_get(held, f"$.{n}", "long" if n in WHOLE else "double") for n in names}
    read = df.withColumns({"__is": F.when(held.isNotNull(), F.schema_of_variant(held)), **{f"__k_{n}": k for n, k in kinds.items()}, **{n: v for n, v in values.items()}})
    kind = {n: F.coalesce(F.col(f"__k_{n}"), F.lit("VOID")) for n in names}
    number = {n: F.when(kind[n] == "BIGINT", True).otherwise(F.lit(n not in WHOLE) & (kind[n].isin("DOUBLE", "FLOAT") | kind[n].startswith("DECIMAL"))) for n in names}

    def off(value: Column, ratio: Column) -> Column:
        return F.abs(value - ratio) > F.greatest(1e-9 * F.greatest(F.abs(value), F.abs(ratio)), F.lit(1e-12))

    tests = [(~F.coalesce(F.col("__is").startswith("OBJECT"), F.lit(False)), "not a JSON object")]
    tests += [(kind[n] == "VOID", f"{n} is missing") for n in names]
    tests += [(~number[n], f"{n} is no {'whole ' if n in WHOLE else ''}number") for n in names]
    tests += [(F.col(n).isNull() | F.isnan(F.col(n).cast("double")) | (F.abs(F.col(n).cast("double")) == float("inf")), f"{n} is not finite") for n in names]
    tests += [(F.col(n) <= 0, f"{n} is not positive") for n in ("n_tokens", "d_model")]
    tests += [(F.col("n_elements").cast("decimal(38,0)") != F.col("n_tokens").cast("decimal(19,0)") * F.col("d_model").cast("decimal(19,0)"), "n_elements is not n_tokens times d_model")]
    tests += [(F.col("sse_recon") < 0, "sse_recon is negative"), (F.col("sse_baseline") <= 0, "sse_baseline is not positive")]
    tests += [(off(F.col(n), F.try_divide(F.col(a), F.col(b))), f"{n} is not {a} / {b}") for n, (a, b) in RATIOS.items()]
    reason = F.lit(None).cast("string")
    for test, said in reversed(tests):
        reason = F.when(test, said).otherwise(reason)
    return read.withColumn("reason", reason).select(*df.columns, *names, "reason")


def checked_metrics(df: DataFrame, text: str) -> DataFrame:
    """The same without `reason`; a bad record is an error."""
    found = strict_metrics(df, text)
    return found.where(F.when(F.col("reason").isNotNull(), F.raise_error(F.col("reason")).cast("boolean")).otherwise(F.lit(True))).drop("reason")
