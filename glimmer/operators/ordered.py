"""Work on relations in order: streams zipped by position, and running sums over ranges.

zipped() lays both relations out as tables bucketed and sorted by their keys, once; then they merge without an exchange.
Every position must be on both sides, once: the first that is not is an error that names it.

running() deals rows to tasks by ranges of (group, order) and moves each range on by the sums of those before, so a group
may be of any size. Nothing is collected.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.sources.store import kept, scratch


def laid_out(df: DataFrame, keys: list[str], buckets: int) -> tuple[DataFrame, str]:
    """df as a table bucketed and sorted by the keys, and its name in the catalog."""
    name = f"glimmer_ordered_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", scratch(df.sparkSession, "ordered")).saveAsTable(name)
    return df.sparkSession.table(name), name


def merged(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of both laid-out sides, by key; a key that is not once on both sides is an error."""

    def marked(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(f"__{side}"), *(F.first(c).alias(c) for c in df.columns if c not in keys))

    both = marked(a, "a").join(marked(b, "b").hint("merge"), keys, "full")
    at = F.concat_ws("/", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
    wrong = F.coalesce(F.col("__a"), F.lit(0)) != 1
    wrong |= F.coalesce(F.col("__b"), F.lit(0)) != 1
    said = F.concat(F.lit("streams differ at "), at, F.lit(": "), F.coalesce("__a", F.lit(0)).cast("string"), F.lit(" rows and "), F.coalesce("__b", F.lit(0)).cast("string"))
    return both.where(F.when(wrong, F.raise_error(said).cast("boolean")).otherwise(F.lit(True))).drop("__a", "__b")


def zipped(a: DataFrame, b: DataFrame, keys: list[str], buckets: int = 8) -> DataFrame:
    """Two streams joined position by position, checked, as a table; keys may not be null."""
    spark = a.sparkSession
    left, x = laid_out(a, keys, buckets)
    right, y = laid_out(b, keys, buckets)
    try:
        return kept(merged(left, right, keys))
    finally:
        for name in (x, y):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name in sums, the sum of its column over the rows before in the group; 0 for the first. The order
    within a group is strict."""
    named = kept(df.select("*", *(c.alias(f"__{name}") for name, c in sums.items())))  # ranges are sampled first: df is computed once
    dealt = kept(named.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy(*by, "__range").agg(*(F.sum(f"__{name}").alias(f"__t_{name}") for name in sums))  # a row a group and range
    ranges = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "__range", *(F.sum(f"__t_{name}").over(ranges).alias(f"__b_{name}") for name in sums))
    here = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select(*df.columns, "__range", *(F.sum(f"__{name}").over(here).alias(f"__l_{name}") for name in sums))
    met = local.join(before, [*by, "__range"])
    zero = F.lit(0)
    return met.select(*df.columns, *(reduce(lambda x, y: x + y, (F.coalesce(f"__l_{name}", zero), F.coalesce(f"__b_{name}", zero))).alias(name) for name in sums))
