"""Labels of patches from labels of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.operators.stats import modal_label


def pixels(masks: DataFrame, mask: str = "mask") -> DataFrame:
    """(example_idx, y, x, label) from masks as arrays of rows."""
    rows = masks.select("example_idx", F.posexplode(mask).alias("y", "line"))
    return rows.select("example_idx", "y", F.posexplode("line").alias("x", "label"))


def patch_labels(px: DataFrame, patch: int, width: int, background: int | None = None) -> DataFrame:
    """(example_idx, token_idx, label): the most frequent label of each square patch, ties to the smaller; with a
    background, it counts only where nothing else is. width: of the image, in patches."""
    token = (F.floor(F.col("y") / patch) * width + F.floor(F.col("x") / patch)).cast("int")
    return modal_label(px.withColumn("token_idx", token), ["example_idx", "token_idx"], background=background).select("example_idx", "token_idx", "label")


def patch_grid(spark: SparkSession, n: int, width: int, height: int) -> DataFrame:
    """One row (w, h): factors of n whose ratio is nearest that of width to height; of equals the one with fewer columns."""
    sides = spark.range(1, n + 1).where(F.lit(n) % F.col("id") == 0).select(F.col("id").alias("w"), F.expr(f"{n} div id").alias("h"))
    gap = F.abs(F.col("w") / F.col("h") - width / height)
    return sides.agg(F.min_by(F.struct("w", "h"), F.struct(gap, F.col("w"))).alias("b")).select("b.w", "b.h")


def patch_grids(images: DataFrame, key: str) -> DataFrame:
    """(key, w, h) by the same rule for each key of rows (key, n, width, height); nothing where n is below 1. Factors are
    found within the row, up to the root of n. Images move once, before anything grows, so that no task holds more than
    its partition of them."""
    n = F.col("n").cast("int")
    low = F.filter(F.sequence(F.lit(1), F.floor(F.sqrt(n)).cast("int")), lambda d: n % d == 0)
    widths = F.concat(low, F.transform(low, lambda d: (n / d).cast("int")))
    shape = F.col("width") / F.col("height")
    grids = F.transform(widths, lambda w: F.struct(F.abs(w / (n / w) - shape).alias("gap"), w.alias("w"), (n / w).cast("int").alias("h")))
    best = images.where(n >= 1).repartition(key).select(key, F.array_min(grids).alias("b"))
    return best.groupBy(key).agg(F.min("b").alias("b")).select(key, "b.w", "b.h")
