"""Operators on sparse codes (row, feature, value). Zeros are absent and count where a definition needs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feature_stats(codes: DataFrame, features: DataFrame, n_samples: int) -> DataFrame:
    """(feature, nnz, sum, mean_value, sparsity) of every feature. nnz counts positive values, sum takes all; mean_value
    is null for a feature that never fires."""
    stats = codes.groupBy("feature").agg(F.count_if(F.col("value") > 0).alias("nnz"), F.sum("value").alias("sum"))
    nnz, total = F.coalesce("nnz", F.lit(0)).cast("long"), F.coalesce("sum", F.lit(0.0))
    return features.join(stats, "feature", "left").select("feature", nnz.alias("nnz"), total.alias("sum"), F.when(nnz > 0, total / nnz).alias("mean_value"), (nnz / F.lit(max(n_samples, 1))).alias("sparsity"))


def masked(codes: DataFrame, keep: Column) -> DataFrame:
    """Codes of rows that a mask keeps; the other rows stay rows of their matrix, without entries."""
    return codes.where(keep)


def topk_per_feature(codes: DataFrame, features: DataFrame, k: int) -> DataFrame:
    """(feature, rank, row, value): the k largest stored values of each feature, ties to the smaller row. Zeros are never
    taken; a short feature is filled with row 0 and value 0."""
    w = Window.partitionBy("feature").orderBy(F.desc("value"), "row")
    top = codes.select("feature", "row", "value").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    slots = features.select("feature", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return slots.join(top, ["feature", "rank"], "left").select("feature", "rank", F.coalesce("row", F.lit(0)).alias("row"), F.coalesce("value", F.lit(0.0)).alias("value"))


def topk_per_row(codes: DataFrame, rows: DataFrame, n_features: int, k: int) -> DataFrame:
    """(row, rank, feature, value): the k largest values of each row, absent zeros included; a zero has feature 0."""
    stored = codes.select("row", "feature", "value")
    counts = stored.groupBy("row").agg(F.count("*").alias("nnz"))
    free = F.lit(n_features) - F.coalesce("nnz", F.lit(0))
    zeros = rows.select("row").join(counts, "row", "left").where(free > 0).select("row", F.explode(F.sequence(F.lit(1), F.least(free, F.lit(k)))).alias("i"))
    zeros = zeros.select("row", F.lit(0).alias("feature"), F.lit(0.0).alias("value"), F.lit(1).alias("filler"))
    w = Window.partitionBy("row").orderBy(F.desc("value"), "filler", "feature")
    return stored.withColumn("filler", F.lit(0)).unionByName(zeros).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("row", "rank", "feature", "value")


def topk_examples(codes: DataFrame, features: DataFrame, k: int, tokens: int, distinct: bool = False) -> DataFrame:
    """(feature, rank, example_idx) of the top rows' examples; distinct keeps the first of each and ranks anew."""
    top = topk_per_feature(codes, features, k).where(F.col("value") > 0).select("feature", "rank", F.floor(F.col("row") / tokens).cast("long").alias("example_idx"))
    if not distinct:
        return top
    first = top.groupBy("feature", "example_idx").agg(F.min("rank").alias("rank"))
    return first.select("feature", F.row_number().over(Window.partitionBy("feature").orderBy("rank")).alias("rank"), "example_idx")


def pool(codes: DataFrame, tokens: int, how: str) -> DataFrame:
    """(example_idx, feature, value) over the tokens of each example: "sum", "mean" or "max", with absent zeros; zeros of
    the result are absent again."""
    if how == "sum":
        out = F.sum("value")
    elif how == "mean":
        out = F.sum("value") / tokens
    elif how == "max":
        out = F.when(F.count("*") < tokens, F.greatest(F.max("value"), F.lit(0.0))).otherwise(F.max("value"))
    else:
        raise ValueError(f"unknown pooling {how}")
    return codes.groupBy("example_idx", "feature").agg(out.alias("value")).where(F.col("value") != 0)


def rms_scale(codes: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, qx): the root mean square of stored values, at least 1e-6; 1 for an empty feature."""
    got = codes.groupBy("feature").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("qx"))
    return features.join(got, "feature", "left").select("feature", F.greatest(F.coalesce("qx", F.lit(1.0)), F.lit(1e-6)).alias("qx"))


def dead_mask(codes: DataFrame, features: DataFrame, n_rows: int, after: int) -> DataFrame:
    """(feature, since, dead): rows since the feature last fired, in row order; dead from `after` on."""
    last = codes.where(F.col("value") > 0).groupBy("feature").agg(F.max("row").alias("last"))
    since = F.lit(n_rows) - 1 - F.coalesce("last", F.lit(-1))
    return features.join(last, "feature", "left").select("feature", since.cast("long").alias("since"), (since >= after).alias("dead"))


def support_by_class(codes: DataFrame, labels: DataFrame) -> DataFrame:
    """(feature, label, support, mean_act): the share of a class's rows where the feature fires, and the mean over all of
    them, zeros included. labels: (row, label)."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    seen = codes.select("row", "feature", "value").join(labels, "row").groupBy("feature", "label").agg(F.count_if(F.col("value") > 0).alias("fired"), F.sum("value").alias("sum"))
    return seen.join(F.broadcast(sizes), "label").select("feature", "label", (F.col("fired") / F.col("n")).alias("support"), (F.col("sum") / F.col("n")).alias("mean_act"))


def in_log_range(stats: DataFrame, freq: tuple[float, float], value: tuple[float, float], strict: bool = True) -> DataFrame:
    """Features whose log10 frequency and log10 mean value lie in the ranges; dead ones never do."""
    f, v = (F.when(F.col(c) > 0, F.log10(F.col(c))) for c in ("sparsity", "mean_value"))
    inside = (f > freq[0]) & (f < freq[1]) & (v > value[0]) & (v < value[1]) if strict else f.between(*freq) & v.between(*value)
    return stats.where(inside)
