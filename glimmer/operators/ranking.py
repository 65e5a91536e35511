"""Ranking metrics on sparse scores. Absent scores are zeros: each list holds them as one group of ties, in closed form.
Ranks are running sums over ranges of (feature, value), so a feature may have any number of distinct values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions.columns import harmonic
from glimmer.operators.ordered import running
from glimmer.sources.store import kept

#: Tasks that the rows of one group are dealt over where its bounds are joined to them.
SALTS = 16


def tie_groups(codes: DataFrame, positives: DataFrame, features: DataFrame, n_rows: int, n_positive: DataFrame) -> DataFrame:
    """(feature, class, value, n, pos, below, total, n_rows): the groups of equal scores that hold a positive row, and of
    each feature and class the group of absent scores, which have value 0; below: rows with lower scores.

    positives: (row, class) of positive rows; n_positive: (class, total). Negative stored scores rank below zero. Rows
    are counted once for each score; classes meet only the scores of their own rows."""
    counts = codes.groupBy("feature", "value").agg(F.count("*").alias("n"))
    absent = features.select("feature").join(counts.groupBy("feature").agg(F.sum("n").alias("s")), "feature", "left")
    absent = absent.select("feature", F.lit(0.0).alias("value"), (F.lit(n_rows) - F.coalesce("s", F.lit(0))).alias("n"))
    every = running(counts.unionByName(absent).groupBy("feature", "value").agg(F.sum("n").alias("n")), ["feature"], [F.col("value")], {"below": F.col("n")})
    hits = codes.join(positives, "row").groupBy("feature", "value", "class").agg(F.count("*").alias("pos"))
    grid = features.select("feature").crossJoin(F.broadcast(n_positive.select("class", "total")))  # by classes, a bounded side
    rest = grid.join(hits.groupBy("feature", "class").agg(F.sum("pos").alias("s")), ["feature", "class"], "left")
    rest = rest.select("feature", F.lit(0.0).alias("value"), "class", (F.col("total") - F.coalesce("s", F.lit(0))).alias("pos"))
    own = hits.unionByName(rest).groupBy("feature", "value", "class").agg(F.sum("pos").alias("pos"))
    found = own.join(every, ["feature", "value"]).join(F.broadcast(n_positive.select("class", "total")), "class")
    return found.select("feature", "class", "value", "n", "pos", "below", "total", F.lit(n_rows).alias("n_rows"))


def auroc(groups: DataFrame) -> DataFrame:
    """(feature, class, auroc) from tie groups, by average ranks; null where a side is empty."""
    sums = groups.groupBy("feature", "class").agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2)).alias("r"), F.max("total").alias("p"), (F.max("n_rows") - F.max("total")).alias("m"))
    return sums.select("feature", "class", F.when((F.col("p") > 0) & (F.col("m") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("m"))).alias("auroc"))


def average_precision(ranked: DataFrame, by: list[str], order: list) -> DataFrame:
    """(by..., ap) of rows (by..., y in 0/1) in a strict order: precision at each positive, averaged; 0 without any."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = ranked.withColumn("k", F.row_number().over(w)).withColumn("tp", F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("tp") / F.col("k"))) / F.when(F.sum("y") > 0, F.sum("y")), F.lit(0.0)).alias("ap"))


def tie_aware_ap(groups: DataFrame, undefined: float | None = 0.0) -> DataFrame:
    """(feature, class, ap): the mean of average precision over all orders of tied scores, in closed form: a group's
    ranks enter by two harmonic numbers, however many they are."""
    t = (F.col("n_rows") - F.col("below") - F.col("n")).cast("double")
    g = running(groups.where("pos > 0 or value = 0").withColumn("t", t), ["feature", "class"], [F.desc("value")], {"r0": F.col("pos")})
    # sum over j = t+1 .. t+n of (r/n) (R + 1 + (j-t-1)(r-1)/(n-1)) / j = (r/n) (R + 1 - (t+1) s) (H(t+n) - H(t)) + (r/n) s n
    slope = F.when(F.col("n") > 1, (F.col("pos") - 1) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    ranks = harmonic(F.col("t") + F.col("n")) - harmonic(F.col("t"))
    part = F.when(F.col("pos") > 0, F.col("pos") / F.col("n") * ((F.col("r0") + 1 - (F.col("t") + 1) * slope) * ranks + slope * F.col("n"))).otherwise(F.lit(0.0))
    total = F.max("total")
    return g.withColumn("part", part).groupBy("feature", "class").agg(F.when(total > 0, F.sum("part") / total).otherwise(F.lit(undefined)).alias("ap"))


def confusion(codes: DataFrame, positives: DataFrame, features: DataFrame, n_positive: DataFrame, n_rows: int, thresholds: list[float]) -> DataFrame:
    """(feature, class, tau, tp, fp, fn, tn) of "score > tau"; thresholds are at least 0, so absent scores are negative."""
    taus = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    fired = codes.select("row", "feature", "value", taus.alias("tau")).where("value > tau")
    sizes = fired.groupBy("feature", "tau").agg(F.count("*").alias("pred"))
    hits = fired.join(positives, "row").groupBy("feature", "tau", "class").agg(F.count("*").alias("tp"))
    grid = features.select("feature", taus.alias("tau")).crossJoin(F.broadcast(n_positive))  # by classes, a bounded side
    tp, pred = F.coalesce("tp", F.lit(0)), F.coalesce("pred", F.lit(0))
    return grid.join(sizes, ["feature", "tau"], "left").join(hits, ["feature", "tau", "class"], "left").select("feature", "class", "tau", tp.alias("tp"), (pred - tp).alias("fp"), (F.col("total") - tp).alias("fn"), (F.lit(n_rows) - pred - F.col("total") + tp).alias("tn"))


def prf1(counts: DataFrame) -> DataFrame:
    """counts with precision, recall and f1; 0 where undefined."""
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    f = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(F.lit(0.0))
    return counts.withColumns({"precision": p, "recall": r, "f1": f})


def dense_quantile(codes: DataFrame, features: DataFrame, n_rows: int, q: float) -> DataFrame:
    """(feature, cut): the quantile of each feature over all rows, zeros included, with linear interpolation. Stored
    values are at least 0."""
    absent = features.select("feature").join(codes.groupBy("feature").agg(F.count("*").alias("nnz")), "feature", "left").select("feature", F.lit(0.0).alias("value"), (F.lit(n_rows) - F.coalesce("nnz", F.lit(0))).alias("n"))
    counted = codes.groupBy("feature", "value").agg(F.count("*").alias("n")).unionByName(absent.where("n > 0"))
    return exact_quantiles(counted, ["feature"], "value", [q], n="n").select("feature", F.col("q0").alias("cut"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, at: list[float], n: str | None = None, accuracy: int = 10_000) -> DataFrame:
    """(by..., q0, q1, ...): quantiles of each group with linear interpolation, exact. A mergeable sketch bounds each of
    them on either side; then only the rows below are counted, and only values between the bounds are put in order.
    n: a column that says how many rows a row stands for (positive, not null)."""
    w = F.col(n).cast("long") if n else F.lit(1).cast("long")
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"), w.alias("w"))
    e = 3.0 / accuracy
    edges = [x for q in at for x in (max(0.0, q - e), min(1.0, q + e))]
    if n is not None:  # rows that stand for many are put in order by their distinct values
        placed = running(rows.groupBy(*by, "v").agg(F.sum("w").alias("w")), by, [F.col("v")], {"before": F.col("w")})
        near = placed.join(rows.groupBy(*by).agg(F.sum("w").alias("total")), by).select(*by, "v", "w", "before", "total")
    else:
        bounds = rows.groupBy(*by).agg(F.percentile_approx("v", edges, accuracy).alias("bounds"), F.sum("w").alias("total"))
        # in a small group the bounds may lie less than a rank away: there all values are put in order
        whole = F.array(*(F.lit(float(x)) for _ in at for x in ("-inf", "inf")))
        bounds = bounds.withColumn("bounds", F.when(F.col("total") <= accuracy, whole).otherwise(F.col("bounds")))
        # as a table, whose size Spark knows: where groups are few it sends them to all tasks, and rows stay where they are;
        # where they are many, rows move, those of one group to SALTS tasks
        bounds = kept(bounds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(bounds, [*by, "salt"])
        inside = reduce(lambda a, b: a | b, [F.col("v").between(F.col("bounds")[2 * i], F.col("bounds")[2 * i + 1]) for i in range(len(at))])
        lows = joined.groupBy(*by).agg(*(F.count_if(F.col("v") < F.col("bounds")[2 * i]).alias(f"low{i}") for i in range(len(at))))
        values = joined.where(inside).groupBy(*by, "v").agg(F.count("*").alias("w"), F.first("bounds").alias("bounds"), F.first("total").alias("total")).join(lows, by)
        near = None
        for i in range(len(at)):
            earlier = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
            own = values.where(F.col("v").between(F.col("bounds")[2 * i], F.col("bounds")[2 * i + 1])).select(*by, "v", "w", (F.col(f"low{i}") + F.coalesce(F.sum("w").over(earlier), F.lit(0))).alias("before"), "total", F.lit(i).alias("i"))
            near = own if near is None else near.unionByName(own)

    def quantile(i: int, q: float) -> F.Column:
        rank = (F.col("total") - 1) * q
        low, high = F.floor(rank), F.ceil(rank)
        mine = F.lit(True) if n is not None else F.col("i") == i

        def holds(r: F.Column) -> F.Column:
            return F.max(F.when(mine & (F.col("before") <= r) & (r < F.col("before") + F.col("w")), F.col("v")))

        part = F.max(rank - low)
        return (holds(low) + (holds(high) - holds(low)) * part).alias(f"q{i}")

    return near.groupBy(*by).agg(*(quantile(i, q) for i, q in enumerate(at)))


def purity_at_k(top: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(feature, purity): the share of the most frequent label among a feature's top rows (feature, row, value > 0)."""
    counts = top.where("value > 0").join(labels, "row").groupBy("feature", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("feature").agg((F.max("n") / k).alias("purity"))


def mean_yield(yields: DataFrame) -> DataFrame:
    """One row (auc_b): the mean of yields over the budgets."""
    return yields.agg(F.avg("yield").alias("auc_b"))


def yield_at_budgets(ranked: DataFrame, budgets: list[int], tau: float) -> DataFrame:
    """(budget, yield): of features (position from 1, ap), the share of the first `budget` with ap >= tau; null counts
    as below. Positions beyond the last count as below too."""
    grid = ranked.select("position", "ap", F.explode(F.array(*(F.lit(b) for b in budgets))).alias("budget"))
    return grid.groupBy("budget").agg((F.count_if((F.col("position") <= F.col("budget")) & (F.col("ap") >= tau)) / F.first("budget")).alias("yield"))
