"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and what the engine does with a million vectors;
prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.functions import columns as C
from glimmer.operators import encode, estimators, probe, sparse, stats
from glimmer.plans.evaluation import QUERIES
from glimmer.plans.relations import FEATURES, TOKENS, Relations
from glimmer.sources import store

HEADLINE = (
    "feature_stats", "recon_metrics", "eval_summary", "topk_per_feature", "topk_per_row", "pool_max", "auroc_by_feature", "ap_tie_aware", "prf1_threshold", "quantile_f1",
    "probe_step", "kmeans_step", "pca_scatter", "topk_orders_by_part", "pareto_strict", "quantile_summary", "head_per_group", "renamed_key_join", "stream_stats", "html_trait_parse",
)

#: Vectors of the larger table, made of the driver's by copies with identifiers of their own.
VECTORS = 1_000_000


class ManyVectors(Relations):
    """The relations over a table of VECTORS vectors."""

    def table(self, name: str) -> DataFrame:
        found = super().table(name)
        return self.many if name == "embeddings" else found

    def build(self) -> None:
        small = super().table("embeddings")
        n = small.count()
        copies = self.spark.range(-(-VECTORS // n)).select(F.col("id").alias("copy"))
        made = small.crossJoin(F.broadcast(copies)).select((F.col("vec_id") + F.col("copy") * n).alias("vec_id"), "label", "embedding")
        self.many = store.kept(made.repartition(32))


def timed(run: Callable[[], object]) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def vectors_a_second(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Vectors a second of scans in order and shuffled, encoding, statistics, reconstruction, a pass of k-means and a probe
    step; each from stored vectors."""
    r = ManyVectors(spark, sf_dir)
    r.build()
    n, weights = r.n_rows, r.weights

    def codes() -> DataFrame:
        return encode.dense_codes(r.acts, weights, "positive", carry=("row", "example_idx", "label"))

    def probe_pass() -> None:
        base = probe.priors(r.n_positive, n)
        noop(probe.step(probe.probe_stats(codes().select("row", "feature", "value"), r.positives, probe.start(r.features, base), base, n), sparse.rms_scale(codes(), r.features)))

    def rebuilt() -> None:
        noop(stats.recon_metrics(encode.reconstructed(r.acts, weights, [FEATURES])))

    work: dict[str, Callable[[], object]] = {
        "scan": lambda: noop(r.acts.agg(F.sum(C.norm(F.col("act"))))),
        "ordered_scan": lambda: noop(store.ordered_scan(r.acts)),
        "shuffled_scan": lambda: noop(store.shuffled_scan(r.acts, 7, ["row"])),
        "encode": lambda: noop(codes()),
        "feature_stats": lambda: noop(sparse.feature_stats(codes(), r.features, n)),
        "topk_per_feature": lambda: noop(sparse.topk_per_feature(codes(), r.features, 16)),
        "pool_max": lambda: noop(sparse.pool(codes(), TOKENS, "max")),
        "reconstruction": rebuilt,
        "kmeans_pass": lambda: estimators.KMeans(weights.dec[:8]).partial_fit(r.acts),
        "probe_step": probe_pass,
    }
    return {name: int(n / timed(run)) for name, run in work.items()}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    noop(QUERIES["feature_stats"](spark, sf_dir))  # starts workers and compiles
    times = {name: round(timed(lambda name=name: noop(QUERIES[name](spark, sf_dir))), 3) for name in HEADLINE}
    rates = vectors_a_second(spark, sf_dir)
    print(json.dumps({"metric": "seconds for all headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "vectors": VECTORS, "vectors_per_second": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
