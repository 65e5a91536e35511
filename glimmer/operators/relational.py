"""Relational operators on frames of runs, labels and results."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.sources.store import kept


def pareto(df: DataFrame, by: list[str], x: str, y: str, strict: bool = False, tie: str | None = None) -> DataFrame:
    """Rows on the lower-left frontier of each group. Not strict: y equals the least y so far in the order (x, y).
    Strict: y is below all before, and nulls are left out."""
    if strict:
        df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last(), F.col(y).asc_nulls_last(), *([tie] if tie else []))
    if strict:
        best = F.min(y).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn("__best", best).where(F.col("__best").isNull() | (F.col(y) < F.col("__best"))).drop("__best")
    return df.withColumn("__best", F.min(y).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(y) == F.col("__best")).drop("__best")


def spaced_frontier(df: DataFrame, by: list[str], x: str, y: str, most: int = 6, tie: str | None = None) -> DataFrame:
    """The strict frontier of each group, thinned to at most `most` points: both ends, and in order the unused point
    nearest each target that is evenly spaced in log(1 + x). A group is its frontier only."""
    front = pareto(df, by, x, y, strict=True, tie=tie)

    def thin(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values([x, y], kind="stable").reset_index(drop=True)
        if len(points) <= most:
            return points
        at = [math.log1p(v) for v in points[x]]
        taken = [0, len(points) - 1]
        for i in range(1, most - 1):
            target = at[0] + (at[-1] - at[0]) * i / (most - 1)
            taken.append(min((j for j in range(len(points)) if j not in taken), key=lambda j: (abs(at[j] - target), j)))
        return points.iloc[sorted(taken)]

    return front.groupBy(*by).applyInPandas(thin, front.schema)


def best_flags(df: DataFrame, by: list[str], value: str, name: str = "is_best") -> DataFrame:
    """df with a flag: the value is the group's largest; ties are all flagged."""
    return df.withColumn(name, F.col(value) == F.max(value).over(Window.partitionBy(*by)))


def edge_flags(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with at_min and at_max: the value is the least or the largest of its group."""
    w = Window.partitionBy(*by)
    return df.withColumn("at_min", F.col(value) == F.min(value).over(w)).withColumn("at_max", F.col(value) == F.max(value).over(w))


def head_per_group(df: DataFrame, by: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def first_per_group(df: DataFrame, by: list[str], least: list[str]) -> DataFrame:
    """The row of each group with the least values of the columns named; combines before the exchange."""
    rest = [c for c in df.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct(*least))
    return df.groupBy(*by).agg(best.alias("r")).select(*by, *(F.col(f"r.{c}").alias(c) for c in rest))


def first_seen(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row of each key that comes first by position."""
    return first_per_group(df, keys, [position])


def factorize(df: DataFrame, keys: list[str], position: str, name: str = "code") -> DataFrame:
    """df with a number for each combination of keys, from 0 in order of first appearance. Combinations are a dimension:
    numbering them takes one sorted pass over the distinct ones."""
    combos = df.groupBy(*keys).agg(F.min(position).alias("__first"))
    numbered = combos.withColumn(name, (F.row_number().over(Window.orderBy("__first", *keys)) - 1).cast("long")).drop("__first")
    return df.join(numbered, keys)


def group_labels(df: DataFrame, label: str, groups: dict[str, list[str]] | None) -> DataFrame:
    """df with group, group_id (dense, by sorted group name) and in_task. Labels in no group get null, -1 and false; a
    label in two groups is an error. Without groups each label is its own."""
    spark = df.sparkSession
    if groups:
        pairs = [(member, name) for name, members in groups.items() for member in members]
        if len({member for member, _ in pairs}) < len(pairs):
            raise ValueError("a label is in two groups")
        ids = {name: i for i, name in enumerate(sorted(groups))}
        dimension = spark.createDataFrame([(m, g, ids[g]) for m, g in pairs], f"`{label}` string, group string, group_id int")
    else:
        distinct = df.select(label).where(F.col(label).isNotNull()).distinct()
        dimension = distinct.select(label, F.col(label).alias("group"), (F.row_number().over(Window.orderBy(label)) - 1).alias("group_id"))
    joined = df.join(F.broadcast(dimension) if groups else dimension, label, "left")
    return joined.withColumn("in_task", F.col("group_id").isNotNull()).withColumn("group_id", F.coalesce("group_id", F.lit(-1)))


def checked_join(left: DataFrame, right: DataFrame, on: list[str], what: str = "key") -> DataFrame:
    """An inner join in which every left row must match; else an error that names a missing key."""
    joined = left.join(right.withColumn("__there", F.lit(True)), on, "left")
    key = F.concat_ws("/", *on)
    return joined.where(F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit(f"no match for {what} "), key)).cast("boolean")).otherwise(F.lit(True))).drop("__there")


def match_rate(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One row: rows of left, how many have a match, and the share."""
    there = left.join(right.select(*on).distinct().withColumn("__there", F.lit(1)), on, "left")
    return there.agg(F.count("*").alias("n"), F.count("__there").alias("matched"), (F.count("__there") / F.count("*")).alias("share"))


def same_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, keys...) of keys that only one side has; empty if the sets are equal."""
    return a.distinct().join(b, a.columns, "left_anti").withColumn("side", F.lit("left")).unionByName(b.distinct().join(a, b.columns, "left_anti").withColumn("side", F.lit("right")))


def one_hot_label(df: DataFrame, columns: dict[str, str], name: str = "category") -> DataFrame:
    """df with the name of the first column that is 1; null if none."""
    return df.withColumn(name, F.coalesce(*(F.when(F.col(c) == 1, F.lit(v)) for c, v in columns.items())))


def unnested(df: DataFrame, column: str, separator: str = "_") -> DataFrame:
    """df with a struct's fields as columns column<separator>field."""
    fields = df.schema[column].dataType.names
    return df.select(*(c for c in df.columns if c != column), *(F.col(f"{column}.{f}").alias(f"{column}{separator}{f}") for f in fields))


def columns_like(df: DataFrame, pattern: str) -> DataFrame:
    """The columns whose whole names match."""
    import re

    return df.select(*(F.col(f"`{c}`") for c in df.columns if re.fullmatch(pattern, c)))


def task_counts(df: DataFrame, by: list[str], side: str, least: int) -> DataFrame:
    """(by..., n_true, n_false, kept): kept if both sides have at least so many rows."""
    got = df.groupBy(*by).agg(F.count_if(F.col(side)).alias("n_true"), F.count_if(~F.col(side)).alias("n_false"))
    return got.withColumn("kept", F.least("n_true", "n_false") >= least)


def task_specs(df: DataFrame, label: str, pairs: DataFrame, views: dict[str, Column], least: int) -> DataFrame:
    """(name, view, left, right, n_left, n_right) of tasks that tell two labels apart in one view of the rows, with at
    least so many rows on either side. pairs: (left, right), a small table; views: conditions by name."""
    per = None
    for name, keep in views.items():
        counts = df.where(keep).groupBy(label).agg(F.count("*").alias("n")).withColumn("view", F.lit(name))
        per = counts if per is None else per.unionByName(counts)
    a, b = (per.select(F.col(label).alias(side), "view", F.col("n").alias(f"n_{side}")) for side in ("left", "right"))
    tasks = pairs.join(a, "left").join(b, ["right", "view"])
    return tasks.where(F.least("n_left", "n_right") >= least).select(F.format_string("%s-%s-%s", "left", "right", "view").alias("name"), "view", "left", "right", "n_left", "n_right")


def ranked(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with places from 1 in a strict order over all rows: rows are dealt by ranges of the order, numbered within each
    range, and moved on by the sizes of the ranges before, of which one number each reaches the driver."""
    spark = df.sparkSession
    dealt = kept(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes, before, held = sorted((r["__range"], r["count"]) for r in dealt.groupBy("__range").count().collect()), [], 0
    for number, size in sizes:
        before.append((number, held))
        held += size
    offsets = F.broadcast(spark.createDataFrame(before, "__range int, __before long"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(offsets, "__range").withColumn(name, (F.col("__before") + own).cast("long")).drop("__range", "__before")
