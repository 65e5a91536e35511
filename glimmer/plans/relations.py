"""The engine's relations over the driver's tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.operators.encode import Weights, datapoint_weights, dense_codes
from glimmer.sources.store import kept

#: Features of the codes, tokens of an example, classes of the labels and dimensions of a vector.
FEATURES, TOKENS, CLASSES, DIMS = 32, 4, 10, 64


class Relations:
    """activations, codes, labels and more of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def acts(self) -> DataFrame:
        """(row, example_idx, token_idx, label, act)."""
        row = F.col("vec_id")
        return self.table("embeddings").select(row.alias("row"), F.expr(f"vec_id div {TOKENS}").alias("example_idx"), (row % TOKENS).alias("token_idx"), "label", F.col("embedding").alias("act"))

    @cached_property
    def n_rows(self) -> int:
        return self.table("embeddings").count()

    @cached_property
    def weights(self) -> Weights:
        return datapoint_weights(self.acts, FEATURES)

    @cached_property
    def features(self) -> DataFrame:
        return self.spark.range(FEATURES).select(F.col("id").cast("int").alias("feature"))

    @cached_property
    def classes(self) -> DataFrame:
        return self.spark.range(CLASSES).select(F.col("id").cast("int").alias("class"))

    @cached_property
    def labels(self) -> DataFrame:
        """(row, label)."""
        return self.acts.select("row", "label")

    @cached_property
    def positives(self) -> DataFrame:
        """(row, class)."""
        return self.acts.select("row", F.col("label").alias("class"))

    @cached_property
    def n_positive(self) -> DataFrame:
        """(class, total) of all classes."""
        got = self.positives.groupBy("class").agg(F.count("*").alias("total"))
        return self.classes.join(got, "class", "left").select("class", F.coalesce("total", F.lit(0)).alias("total"))

    @cached_property
    def codes(self) -> DataFrame:
        """(row, example_idx, token_idx, label, feature, value), positive values; encoded once and written out."""
        return kept(self.codes_of("positive"))

    def codes_of(self, keep: str, **more: float) -> DataFrame:
        return dense_codes(self.acts, self.weights, keep, carry=("row", "example_idx", "token_idx", "label"), **more)
