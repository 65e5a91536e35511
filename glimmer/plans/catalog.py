"""The engine's queries over the driver's tables; each has SQL of the same name in oracle.py unless that module says why not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.functions import columns as C
from glimmer.operators import classify, encode, estimators, pixels, probe, ranking, relational, sparse, stats
from glimmer.plans import sweep
from glimmer.plans.relations import CLASSES, DIMS, FEATURES, TOKENS, Relations
from glimmer.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Relations], DataFrame]) -> Callable[[Relations], DataFrame]:
    """Registers f under its name."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
    return f


def r6(c: str | Column, name: str | None = None) -> Column:
    out = F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)
    return out.alias(name or c)


# --- scans


@query
def activation_scan_ordered(r: Relations) -> DataFrame:
    return store.ordered_scan(r.acts).select("row", "example_idx", "token_idx", "label", r6(C.norm(F.col("act")), "size"))


@query
def index_map(r: Relations) -> DataFrame:
    layout = store.Layout(TOKENS, True, (0, 1), DIMS, r.n_rows // TOKENS, 200)
    return store.addresses(r.acts.select(F.col("row").alias("i")), layout, layer_position=1).select("i", "example_idx", "token_idx", "shard_idx", "example_in_shard", "token_in_shard", "byte_offset")


@query
def shuffled_scan(r: Relations) -> DataFrame:
    return store.shuffled_scan(r.labels, 7, ["row"], [0, 3]).select("row", "label", "shuffle_key")


@query
def point_lookup(r: Relations) -> DataFrame:
    return store.lookup(r.acts, [0, 17, 123, 499], r.n_rows).select("row", "example_idx", "token_idx", "label")


@query
def whole_batches(r: Relations) -> DataFrame:
    return store.with_batches(r.labels, 64, r.n_rows, drop_last=True).groupBy("batch").agg(F.count("*").alias("n"))


@query
def replayed_epochs(r: Relations) -> DataFrame:
    return store.limited(r.labels, 64, r.n_rows, 2 * r.n_rows).groupBy("epoch").agg(F.count("*").alias("n"), F.max("row").alias("last_row"))


@query
def label_filter_count(r: Relations) -> DataFrame:
    return r.labels.where(~F.col("label").isin(0, 3)).groupBy("label").agg(F.count("*").alias("n"))


@query
def store_size(r: Relations) -> DataFrame:
    return r.acts.agg(F.countDistinct("example_idx").alias("n_examples")).select("n_examples", stats.expected_bytes(F.col("n_examples"), TOKENS, 2, DIMS).alias("n_bytes"))


# --- codes


@query
def codes_relu(r: Relations) -> DataFrame:
    return r.codes.select("row", "feature", r6("value"))


@query
def codes_topk(r: Relations) -> DataFrame:
    return r.codes_of("topk", k=4).select("row", "feature", r6("value"))


@query
def codes_batch_topk(r: Relations) -> DataFrame:
    return encode.batch_topk(r.codes_of("all"), 4, 50).select("batch", "row", "feature", r6("value"))


@query
def codes_jumprelu(r: Relations) -> DataFrame:
    return r.codes_of("jump", threshold=0.05).select("row", "feature", r6("value"))


def rebuilt(r: Relations, prefixes: list[int]) -> DataFrame:
    """(row, prefix, x, x_hat); a row without codes is rebuilt as the bias."""
    decoded = encode.decode_prefixes(r.codes, r.weights, prefixes)
    zero = F.array(*(F.lit(float(b)) for b in r.weights.bias_dec))
    grid = r.acts.select("row", F.col("act").alias("x"), F.explode(F.array(*(F.lit(p) for p in prefixes))).alias("prefix"))
    return grid.join(decoded, ["row", "prefix"], "left").withColumn("x_hat", F.coalesce("x_hat", zero))


@query
def decode_prefixes(r: Relations) -> DataFrame:
    return rebuilt(r, [8, 16, FEATURES]).select("row", "prefix", r6(C.norm(F.col("x_hat")), "size"), r6(C.squared_distance(F.col("x"), F.col("x_hat")), "sse"))


@query
def feature_edit(r: Relations) -> DataFrame:
    made = encode.edited(r.acts.select("row", "act"), r.codes, r.weights, 3, 0.5)
    return made.join(r.acts.select("row", F.col("act").alias("x")), "row").select("row", r6(C.norm(F.col("act")), "size"), r6(C.squared_distance(F.col("x"), F.col("act")), "moved"))


def relu_stats(r: Relations) -> DataFrame:
    return sparse.feature_stats(r.codes, r.features, r.n_rows)


@query
def feature_stats(r: Relations) -> DataFrame:
    return relu_stats(r).select("feature", "nnz", r6("sum"), r6("mean_value"), r6("sparsity"))


@query
def feature_stats_masked(r: Relations) -> DataFrame:
    """Ignored labels leave the counts, not the denominator."""
    return sparse.feature_stats(sparse.masked(r.codes, ~F.col("label").isin(0, 3)), r.features, r.n_rows).select("feature", "nnz", r6("sum"), r6("mean_value"), r6("sparsity"))


@query
def recon_metrics(r: Relations) -> DataFrame:
    found = stats.recon_metrics(encode.reconstructed(r.acts, r.weights, [FEATURES]))
    return found.select("n_tokens", "d_model", *(r6(c) for c in found.columns[2:]))


@query
def explained_variance(r: Relations) -> DataFrame:
    return stats.explained_variance(encode.reconstructed(r.acts, r.weights, [FEATURES])).select(r6("explained"))


@query
def aux_loss(r: Relations) -> DataFrame:
    """Mean squared distance between what living features leave over and what the top dead ones decode to."""
    dead = sparse.dead_mask(r.codes_of("jump", threshold=0.4), r.features, r.n_rows, 100).where("dead")
    living = r.codes.join(F.broadcast(dead.select("feature")), "feature", "left_anti")
    zero = F.array_repeat(F.lit(0.0), DIMS)
    alive = encode.decode_prefixes(living, r.weights, [FEATURES]).select("row", F.col("x_hat").alias("alive"))
    aux = encode.decode_prefixes(encode.aux_codes(r.codes_of("all"), dead, 4), r.weights, [FEATURES]).select("row", F.col("x_hat").alias("aux"))
    full = r.acts.join(alive, "row", "left").join(aux, "row", "left").withColumns({"alive": F.coalesce("alive", zero), "aux": F.coalesce("aux", zero)})
    left = F.zip_with("act", "alive", lambda x, y: x.cast("double") - y)
    return full.select(C.squared_distance(left, F.col("aux")).alias("d")).agg((F.avg("d") / DIMS).alias("aux_mse")).select(r6("aux_mse"))


@query
def eval_summary(r: Relations) -> DataFrame:
    return stats.eval_summary(r.codes, relu_stats(r), r.n_rows).select(r6("l0"), r6("l1"), "n_dead", "n_almost_dead", "n_dense")


@query
def log_range_features(r: Relations) -> DataFrame:
    return sparse.in_log_range(relu_stats(r), (-0.5, 0.0), (-2.0, -0.5)).select("feature", r6("sparsity"), r6("mean_value"))


@query
def rms_scale(r: Relations) -> DataFrame:
    return sparse.rms_scale(r.codes, r.features).select("feature", r6("qx"))


@query
def support_by_class(r: Relations) -> DataFrame:
    return sparse.support_by_class(r.codes.select("row", "feature", "value"), r.labels).select("feature", "label", r6("support"), r6("mean_act"))


@query
def dead_tracker(r: Relations) -> DataFrame:
    return sparse.dead_mask(r.codes_of("jump", threshold=0.4), r.features, r.n_rows, 100)


# --- entropy, modes, patches


@query
def batch_entropy(r: Relations) -> DataFrame:
    users = r.table("events")
    return stats.key_entropy(users, "user_id", 1000).select(r6("entropy"), r6("normalised"), r6("coverage"))


def over_quantile(r: Relations, q: float) -> DataFrame:
    """(row, feature, label) where a feature lies above its quantile."""
    cuts = ranking.dense_quantile(r.codes.select("row", "feature", "value"), r.features, r.n_rows, q)
    return r.codes.join(F.broadcast(cuts), "feature").where("value > cut").select("row", "feature", "label")


@query
def label_entropy(r: Relations) -> DataFrame:
    return stats.label_entropy(over_quantile(r, 0.95), r.features, CLASSES).select("feature", "support", r6("entropy"), r6("concentration"))


@query
def token_label_majority(r: Relations) -> DataFrame:
    return stats.modal_label(r.acts, ["example_idx"])


@query
def token_label_prefer_fg(r: Relations) -> DataFrame:
    return stats.modal_label(r.acts.withColumn("label", F.col("label") % 3), ["example_idx"], background=0)


@query
def pixel_patches(r: Relations) -> DataFrame:
    """Rows as pixels of 8 by 8 images, in patches of 2 by 2."""
    px = r.acts.select(F.expr("row div 64").alias("example_idx"), F.expr("row % 64 div 8").alias("y"), (F.col("row") % 8).alias("x"), (F.col("label") % 4).alias("label"))
    return pixels.patch_labels(px, 2, 4).select("example_idx", "token_idx", "label")


@query
def patch_grid(r: Relations) -> DataFrame:
    """Of each part as an image, the grid of patches whose shape is nearest to it."""
    key = F.col("p_partkey")
    images = r.table("part").select("p_partkey", ((key % 40 + 1) * 6).cast("int").alias("n"), (key % 7 + 1).alias("width"), (key % 5 + 1).alias("height"))
    return pixels.patch_grids(images, "p_partkey")


@query
def pure_patch_counts(r: Relations) -> DataFrame:
    shares = stats.modal_share(r.acts.withColumn("label", F.col("label") % 3), ["example_idx"])
    return stats.pure_counts(shares, r.classes.where("class < 3").select(F.col("class").alias("label")), 0.75)


@query
def class_iou(r: Relations) -> DataFrame:
    guesses = r.acts.select("label", F.explode(F.array(F.struct(F.lit("near").alias("model"), (F.col("row") % 10).cast("int").alias("pred")), F.struct(F.lit("low").alias("model"), F.least("label", F.lit(4)).alias("pred")))).alias("g")).select("label", "g.*")
    return stats.class_iou(guesses, r.classes.select(F.col("class").alias("label")), ignored=9).select("model", "label", r6("iou"))


@query
def balanced_accuracy(r: Relations) -> DataFrame:
    guesses = r.acts.select("label", F.explode(F.sequence(F.lit(2), F.lit(9), F.lit(3))).alias("model")).withColumn("pred", F.least("label", F.col("model")))
    return stats.accuracies(guesses, ["model"]).select("model", r6("accuracy"), r6("balanced"), r6("majority"))


@query
def intervention_report(r: Relations) -> DataFrame:
    moved = r.acts.select(F.col("label").alias("before"), F.when(F.col("row") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("after"))
    return stats.intervention_report(moved, 4).select(r6("target_changed"), r6("other_changed"), r6("other_std"), F.array_join(F.transform("went", lambda x: F.format_string("%d:%d", x["label"], x["n"])), ",").alias("went"))


# --- pooling, top-k


@query
def pool_max(r: Relations) -> DataFrame:
    return sparse.pool(r.codes, TOKENS, "max").select("example_idx", "feature", r6("value"))


@query
def pool_mean(r: Relations) -> DataFrame:
    return sparse.pool(r.codes, TOKENS, "mean").select("example_idx", "feature", r6("value"))


@query
def pool_sum(r: Relations) -> DataFrame:
    return sparse.pool(r.codes, TOKENS, "sum").select("example_idx", "feature", r6("value"))


@query
def topk_per_feature(r: Relations) -> DataFrame:
    return sparse.topk_per_feature(r.codes, r.features, 16).select("feature", "rank", "row", r6("value"))


@query
def topk_per_row(r: Relations) -> DataFrame:
    rows = r.acts.select("row")
    return sparse.topk_per_row(r.codes_of("jump", threshold=0.1), rows, FEATURES, 3).select("row", "rank", "feature", r6("value"))


@query
def topk_examples(r: Relations) -> DataFrame:
    return sparse.topk_examples(r.codes, r.features, 16, TOKENS, distinct=True)


@query
def topk_orders_by_part(r: Relations) -> DataFrame:
    """The same operator on a larger matrix: orders by suppliers, quantities as values."""
    lines = r.table("lineitem").groupBy(F.col("l_suppkey").alias("feature"), F.col("l_orderkey").alias("row")).agg(F.sum("l_quantity").alias("value"))
    return sparse.topk_per_feature(lines, lines.select("feature").distinct(), 5).select("feature", "rank", "row", r6("value"))


@query
def farthest_points(r: Relations) -> DataFrame:
    means = estimators.KMeans(r.weights.dec[:4])
    return means.assign(r.acts).orderBy(F.desc("distance"), "row").limit(8).select("row", "center", r6("distance"))


@query
def exact_subset(r: Relations) -> DataFrame:
    return r.labels.orderBy(C.shuffle_key(3, F.col("row"))).limit(50).select("row", "label")


# --- ranking metrics


def groups(r: Relations) -> DataFrame:
    return ranking.tie_groups(r.codes.select("row", "feature", "value"), r.positives, r.features, r.n_rows, r.n_positive)


@query
def auroc_by_feature(r: Relations) -> DataFrame:
    return ranking.auroc(groups(r)).select("feature", "class", r6("auroc"), r6(F.abs(F.col("auroc") - 0.5), "selectivity"))


@query
def ap_by_class(r: Relations) -> DataFrame:
    """Standard average precision of lang = "en" and of quality by text length."""
    docs = r.table("documents").join(r.table("labels"), "doc_id").select("doc_id", "n_chars", "lang", F.col("quality").alias("y"))
    return ranking.average_precision(docs, ["lang"], [F.desc("n_chars"), "doc_id"]).select("lang", r6("ap"))


@query
def ap_tie_aware(r: Relations) -> DataFrame:
    return ranking.tie_aware_ap(groups(r)).select("feature", "class", r6("ap"))


@query
def macro_ap_skip_undefined(r: Relations) -> DataFrame:
    few = r.positives.where("class < 6")
    grouped = ranking.tie_groups(r.codes.select("row", "feature", "value"), few, r.features, r.n_rows, r.classes.join(few.groupBy("class").agg(F.count("*").alias("total")), "class", "left").fillna(0))
    per = ranking.tie_aware_ap(grouped, undefined=None)
    macro = per.groupBy("feature").agg(F.avg("ap").alias("macro_ap"))
    return macro.select("feature", r6("macro_ap"))


@query
def prf1_threshold(r: Relations) -> DataFrame:
    counts = ranking.confusion(r.codes.select("row", "feature", "value"), r.positives, r.features, r.n_positive, r.n_rows, [0.0, 0.1, 0.3])
    return ranking.prf1(counts).select("feature", "class", r6("tau"), "tp", "fp", "fn", "tn", r6("precision"), r6("recall"), r6("f1"))


@query
def best_feature_per_class(r: Relations) -> DataFrame:
    counts = ranking.prf1(ranking.confusion(r.codes.select("row", "feature", "value"), r.positives, r.features, r.n_positive, r.n_rows, [0.0, 0.1, 0.3]))
    allowed = counts.join(F.broadcast(relu_stats(r).select("feature", "sparsity")), "feature").withColumn("f1", F.round(F.when(F.col("sparsity") < 0.9, F.col("f1")).otherwise(-1.0), 6))
    best = F.max_by(F.struct("feature", "tau", "f1"), F.struct(F.col("f1"), -F.col("tau"), -F.col("feature")))
    return allowed.groupBy("class").agg(best.alias("b")).select("class", "b.feature", r6("b.tau", "tau"), r6("b.f1", "f1"))


@query
def quantile_f1(r: Relations) -> DataFrame:
    on = over_quantile(r, 0.95).select("row", "feature", F.lit(1.0).alias("value"))
    counts = ranking.confusion(on, r.positives, r.features, r.n_positive, r.n_rows, [0.0])
    return ranking.prf1(counts).select("feature", "class", r6("precision"), r6("recall"), r6("f1"))


@query
def purity_at_k(r: Relations) -> DataFrame:
    top = sparse.topk_per_feature(r.codes, r.features, 16)
    return ranking.purity_at_k(top, r.labels, 16).select("feature", r6("purity"))


@query
def coverage_at_tau(r: Relations) -> DataFrame:
    best = ranking.tie_aware_ap(groups(r)).groupBy("class").agg(F.max("ap").alias("ap"))
    return best.agg(F.avg((F.col("ap") > 0.3).cast("double")).alias("coverage")).select(r6("coverage"))


@query
def yield_at_b(r: Relations) -> DataFrame:
    """Features by firing frequency, judged by their best class."""
    ap = ranking.tie_aware_ap(groups(r)).groupBy("feature").agg(F.max("ap").alias("ap"))
    order = relu_stats(r).select("feature", F.row_number().over(Window.orderBy(F.desc("nnz"), "feature")).alias("position"))  # one row a feature
    found = ranking.yield_at_budgets(order.join(ap, "feature"), [3, 10, 30, 100], 0.2)
    return found.select("budget", r6("yield"))


@query
def audit_union(r: Relations) -> DataFrame:
    """Features among the first five of either ranking."""
    by_nnz = relu_stats(r).orderBy(F.desc("nnz"), "feature").limit(5).select("feature")
    by_sum = relu_stats(r).orderBy(F.desc("sum"), "feature").limit(5).select("feature")
    return by_nnz.union(by_sum).distinct()


# --- probes


@query
def probe_step(r: Relations) -> DataFrame:
    base = probe.priors(r.n_positive, r.n_rows)
    own = r.codes.select("row", "feature", "value")
    found = probe.probe_stats(own, r.positives, probe.start(r.features, base), base, r.n_rows)
    return probe.step(found, sparse.rms_scale(r.codes, r.features)).select("feature", "class", r6("b"), r6("w"))


def one_step(r: Relations) -> tuple[DataFrame, DataFrame]:
    """Parameters after one step, and the priors."""
    base = probe.priors(r.n_positive, r.n_rows)
    found = probe.probe_stats(r.codes.select("row", "feature", "value"), r.positives, probe.start(r.features, base), base, r.n_rows)
    return probe.step(found, sparse.rms_scale(r.codes, r.features)).select("feature", "class", "b", "w", "damping"), base


@query
def probe_loss(r: Relations) -> DataFrame:
    params, base = one_step(r)
    return probe.probe_stats(r.codes.select("row", "feature", "value"), r.positives, params, base, r.n_rows).select("feature", "class", r6("loss"))


@query
def probe_confusion(r: Relations) -> DataFrame:
    params, base = one_step(r)
    return probe.probe_confusion(r.codes.select("row", "feature", "value"), r.positives, params, base, r.n_rows, 0.12).select("feature", "class", "tp", "fp", "tn", "fn")


def losses(r: Relations) -> DataFrame:
    params, base = one_step(r)
    return probe.probe_stats(r.codes.select("row", "feature", "value"), r.positives, params, base, r.n_rows).withColumn("loss", F.round("loss", 9))


@query
def best_latent_per_class(r: Relations) -> DataFrame:
    best = F.min_by(F.struct("feature", "loss"), F.struct("loss", "feature"))
    return losses(r).groupBy("class").agg(best.alias("b")).select("class", "b.feature", r6("b.loss", "loss"))


@query
def probe_r(r: Relations) -> DataFrame:
    best = losses(r).groupBy("class").agg(F.min("loss").alias("ce"))
    return stats.probe_r(best, probe.priors(r.n_positive, r.n_rows).select("class", F.col("mean").alias("p"))).select(r6("probe_r"))


@query
def best_prototype_ap(r: Relations) -> DataFrame:
    """The feature with the best average precision of each class on four fifths of the examples, and its value on the rest."""

    def part(test: bool) -> DataFrame:
        kept = (F.col("example_idx") % 5 == 0) if test else (F.col("example_idx") % 5 != 0)
        acts = r.acts.where(kept)
        totals = r.classes.join(acts.groupBy(F.col("label").alias("class")).agg(F.count("*").alias("total")), "class", "left").fillna(0)
        grouped = ranking.tie_groups(r.codes.where(kept).select("row", "feature", "value"), acts.select("row", F.col("label").alias("class")), r.features, acts.count(), totals)
        return ranking.tie_aware_ap(grouped).withColumn("ap", F.round("ap", 9))

    best = part(False).groupBy("class").agg(F.max_by(F.struct("feature", "ap"), F.struct(F.col("ap"), -F.col("feature"))).alias("b")).select("class", "b.feature", F.col("b.ap").alias("train_ap"))
    return best.join(part(True).withColumnRenamed("ap", "test_ap"), ["class", "feature"]).select("class", "feature", r6("train_ap"), r6("test_ap"))


def examples(r: Relations) -> DataFrame:
    """(example_idx, label, at, of): max-pooled codes and the majority label."""
    labelled = stats.modal_label(r.acts, ["example_idx"]).select("example_idx", "label")
    return classify.example_rows(sparse.pool(r.codes, TOKENS, "max"), labelled)


@query
def l1_feature_ranking(r: Relations) -> DataFrame:
    """Logistic regression with an absolute penalty (C = 1): the sums of absolute weights."""
    return classify.feature_ranking(classify.l1_logistic(examples(r), FEATURES, CLASSES, c=1.0), FEATURES, r.spark).select("feature", r6("importance"), "place")


@query
def tree_feature_ranking(r: Relations) -> DataFrame:
    """A decision tree of depth five: the shares of lowered impurity."""
    return classify.feature_ranking(classify.tree(examples(r), FEATURES, CLASSES), FEATURES, r.spark).select("feature", r6("importance"), "place")


# --- estimators


@query
def kmeans_assign(r: Relations) -> DataFrame:
    return estimators.KMeans(r.weights.dec[:8]).assign(r.acts).select("row", "center", r6("distance"))


@query
def kmeans_codes(r: Relations) -> DataFrame:
    return estimators.KMeans(r.weights.dec[:8]).codes(r.acts).select("row", "feature", r6("value"))


@query
def kmeans_step(r: Relations) -> DataFrame:
    fitted = estimators.KMeans(r.weights.dec[:8]).partial_fit(r.acts)
    rows = [(i, int(n), d, float(v)) for i, (n, c) in enumerate(zip(fitted.counts, fitted.centres, strict=True)) for d, v in enumerate(c)]
    return r.spark.createDataFrame(rows, "center int, n long, d int, v double").select("center", "n", "d", r6("v"))


@query
def kmeans_eval(r: Relations) -> DataFrame:
    return estimators.KMeans(r.weights.dec[:8]).evaluate(r.acts).select(r6("inertia"), r6("utilisation"), r6("mean_population"), "max_population")


@query
def pca_scatter(r: Relations) -> DataFrame:
    fitted = estimators.Pca().partial_fit(r.acts)
    rows = [(i, j, float(fitted.scatter[i, j] / (fitted.n - 1))) for i in range(DIMS) for j in range(i, DIMS)]
    return r.spark.createDataFrame(rows, "i int, j int, covariance double").select("i", "j", r6("covariance"))


@query
def pca_nmse(r: Relations) -> DataFrame:
    fitted = estimators.Pca().partial_fit(r.acts)
    pairs = fitted.transform(r.acts, 8).join(r.acts.select("row", F.col("act").alias("x")), "row")
    return stats.recon_metrics(pairs).select("n_tokens", r6("nmse"))


@query
def semi_nmf_nmse(r: Relations) -> DataFrame:
    fitted = estimators.SemiNmf(r.weights.dec[:8].copy())
    for _ in range(3):
        fitted = fitted.partial_fit(r.acts)
    pairs = fitted.transform(r.acts).join(r.acts.select("row", F.col("act").alias("x")), "row")
    return stats.recon_metrics(pairs).select("n_tokens", r6("nmse"))


@query
def coherence(r: Relations) -> DataFrame:
    return estimators.coherence(r.weights.dec, r.spark).select("i", "j", r6("coherence"))


# --- relational


def parts(r: Relations) -> DataFrame:
    return r.table("part")


@query
def pareto_nonstrict(r: Relations) -> DataFrame:
    return relational.pareto(parts(r), ["p_brand"], "p_size", "p_retailprice", tie="p_partkey").select("p_brand", "p_partkey", "p_size", r6("p_retailprice"))


@query
def pareto_strict(r: Relations) -> DataFrame:
    return relational.pareto(parts(r), ["p_brand"], "p_size", "p_retailprice", strict=True, tie="p_partkey").select("p_brand", "p_partkey", "p_size", r6("p_retailprice"))


@query
def pareto_log_spaced(r: Relations) -> DataFrame:
    front = relational.spaced_frontier(parts(r).select("p_brand", "p_partkey", "p_size", "p_retailprice"), ["p_brand"], "p_size", "p_retailprice", 3, tie="p_partkey")
    return front.select("p_brand", "p_partkey", "p_size", r6("p_retailprice"))


@query
def run_leaderboard(r: Relations) -> DataFrame:
    front = relational.pareto(parts(r), ["p_brand"], "p_size", "p_retailprice", tie="p_partkey")
    return front.groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("best")).select("p_brand", "n", r6("best"))


@query
def best_per_group(r: Relations) -> DataFrame:
    flagged = relational.best_flags(r.table("customer"), ["c_nationkey"], "c_acctbal")
    return flagged.where("is_best").select("c_nationkey", "c_custkey", r6("c_acctbal"))


@query
def edge_flags(r: Relations) -> DataFrame:
    return relational.edge_flags(parts(r), ["p_brand"], "p_size").select("p_partkey", "at_min", "at_max")


@query
def head_per_group(r: Relations) -> DataFrame:
    return relational.head_per_group(r.table("orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "rank", "o_orderkey", r6("o_totalprice"))


@query
def first_per_group(r: Relations) -> DataFrame:
    return relational.first_per_group(r.table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderkey", r6("o_totalprice"))


@query
def global_rank(r: Relations) -> DataFrame:
    return relational.ranked(r.table("supplier").select("s_suppkey", "s_acctbal"), [F.coalesce("s_acctbal", F.lit(1e9)).desc(), F.col("s_suppkey")]).select("s_suppkey", F.col("place").cast("int").alias("place"))


@query
def label_grouping(r: Relations) -> DataFrame:
    docs = r.table("documents").select("doc_id", "lang")
    return relational.group_labels(docs, "lang", {"romance": ["fr", "es"], "germanic": ["de", "en"]} | {"none": ["xx"]}).select("doc_id", "lang", "group", "group_id", "in_task")


@query
def identity_grouping(r: Relations) -> DataFrame:
    return relational.group_labels(r.table("documents").select("doc_id", "source"), "source", None).select("doc_id", F.col("group_id").cast("int").alias("group_id"))


@query
def factorize(r: Relations) -> DataFrame:
    return relational.factorize(r.table("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"], "o_orderkey").select("o_orderkey", "code")


@query
def first_seen(r: Relations) -> DataFrame:
    return relational.first_seen(r.table("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query
def semi_join(r: Relations) -> DataFrame:
    return r.table("documents").join(r.table("labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang", "source")


@query
def anti_join(r: Relations) -> DataFrame:
    return r.table("documents").join(r.table("labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query
def left_join_match_rate(r: Relations) -> DataFrame:
    return relational.match_rate(r.table("documents"), r.table("labels"), ["doc_id"]).select("n", "matched", r6("share"))


@query
def bounds_join(r: Relations) -> DataFrame:
    """Rows beside the bounds of their group."""
    c = r.table("customer")
    bounds = c.groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))
    return c.join(bounds, "c_mktsegment").where((F.col("c_acctbal") == F.col("low")) | (F.col("c_acctbal") == F.col("high"))).select("c_custkey", "c_mktsegment", r6("low"), r6("high"))


@query
def renamed_key_join(r: Relations) -> DataFrame:
    o, c = r.table("orders"), r.table("customer")
    return c.join(o, c.c_custkey == o.o_custkey).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")).select("c_nationkey", "n", F.round("total", 2).alias("total"))


@query
def lookup_collect(r: Relations) -> DataFrame:
    n, g = r.table("nation"), r.table("region")
    return n.join(g, n.n_regionkey == g.r_regionkey).groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query
def key_set_difference(r: Relations) -> DataFrame:
    return relational.same_keys(r.table("documents").select("doc_id"), r.table("labels").select("doc_id"))


@query
def union_distinct(r: Relations) -> DataFrame:
    return r.table("customer").select(F.col("c_nationkey").alias("key")).unionByName(r.table("supplier").select(F.col("s_nationkey").alias("key"))).distinct()


@query
def membership_flag(r: Relations) -> DataFrame:
    seen = r.table("labels").where("toxic = 1").select("doc_id").distinct().withColumn("__in", F.lit(True))
    return r.table("documents").join(seen, "doc_id", "left").select("doc_id", F.col("__in").isNotNull().alias("is_toxic"))


@query
def onehot_coalesce(r: Relations) -> DataFrame:
    docs = r.table("documents").select("doc_id", *((F.col("lang") == x).cast("int").alias(f"is_{x}") for x in ("de", "fr", "es")))
    return relational.one_hot_label(docs, {"is_de": "German", "is_fr": "French", "is_es": "Spanish"}).select("doc_id", "category")


@query
def explode_unnest(r: Relations) -> DataFrame:
    runs = r.table("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("runs"))
    return relational.unnested(runs.select("o_custkey", F.explode("runs").alias("run")), "run").select("o_custkey", "run_o_orderkey", r6("run_o_totalprice"))


@query
def quantile_summary(r: Relations) -> DataFrame:
    found = stats.quantiles(r.table("lineitem"), ["l_returnflag"], "l_extendedprice")
    return found.select("l_returnflag", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max", "q05", "q50", "q95")))


@query
def task_counts(r: Relations) -> DataFrame:
    both = r.table("documents").join(r.table("labels"), "doc_id").withColumn("good", F.col("quality") == 1)
    return relational.task_counts(both, ["lang"], "good", 5)


@query
def task_specs(r: Relations) -> DataFrame:
    pairs = r.spark.createDataFrame([("en", "de"), ("en", "fr"), ("de", "es"), ("fr", "es")], "left string, right string")
    views = {"short": F.col("n_chars") < 1000, "long": F.col("n_chars") >= 1000}
    return relational.task_specs(r.table("documents"), "lang", pairs, views, 30)


@query
def filter_pack(r: Relations) -> DataFrame:
    return r.table("customer").where(((F.col("c_mktsegment").isin("BUILDING", "MACHINERY")) & F.col("c_acctbal").between(0, 5000)) | (F.col("c_nationkey") == 3)).where(~F.col("c_name").contains("99")).select("c_custkey")


@query
def lenient_cast(r: Relations) -> DataFrame:
    return r.table("documents").select("doc_id", F.regexp_replace("source", "src", "").try_cast("int").alias("source_no"), F.col("lang").try_cast("int").alias("bad"))


# --- text, scalars, json


@query
def html_trait_parse(r: Relations) -> DataFrame:
    text = store.page_text(F.col("html"))
    return r.table("pages").select("page_id", F.length(text).cast("long").alias("n_text"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("long").alias("n_paragraphs"), text.contains("the").alias("has_the"))


@query
def scalar_pack(r: Relations) -> DataFrame:
    t = r.table("part")
    words = F.split("p_name", " ")
    return t.select(
        "p_partkey", F.element_at(words, 1).alias("first_word"), F.element_at(words, -1).alias("last_word"), F.lower("p_brand").alias("brand"), C.safe_name(F.concat_ws("/", "p_brand", "p_type")).alias("safe"), C.stem(F.concat(F.lit("/a/b/"), "p_brand", F.lit(".tar.gz"))).alias("stem"),
        r6(C.safe_log10(F.col("p_retailprice")), "log_price"), r6(C.sigmoid(F.col("p_size") / 10.0 - 2), "p"), r6(C.bce_with_logits(F.col("p_size") / 10.0 - 2, F.lit(1.0)), "bce"), r6(C.clip(F.col("p_retailprice"), 950.0, 1000.0), "clipped"), r6(C.hz_to_mel(F.col("p_retailprice")), "mel"), r6(C.mapped_range(F.col("p_size").cast("double"), 0.0, 100.0, -1.0, 1.0), "mapped"),
    )


@query
def json_fields(r: Relations) -> DataFrame:
    return r.table("events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query
def colours(r: Relations) -> DataFrame:
    made = r.table("nation").select("n_nationkey", F.format_string("#%02x%02x%02x", F.col("n_nationkey") * 10, F.col("n_nationkey"), F.lit(255)).alias("colour"))
    c = C.hex_colour(F.col("colour"))
    return made.select("n_nationkey", r6(c[0], "red"), r6(c[1], "green"), r6(c[2], "blue"))


@query
def content_identity(r: Relations) -> DataFrame:
    return r.table("region").select("r_regionkey", C.content_hash(F.col("r_name"), F.col("r_regionkey")).alias("id"))


# --- configurations


@query
def grid_expand(r: Relations) -> DataFrame:
    """All combinations of the choices that tables hold."""
    orders = r.table("orders")
    return sweep.grid_of(orders.select("o_orderpriority").distinct(), orders.select("o_orderstatus").distinct(), r.table("customer").select("c_mktsegment").distinct())


@query
def config_groups(r: Relations) -> DataFrame:
    made = r.table("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return sweep.groups(made, ["o_orderstatus", "o_orderpriority"], 4, ["o_orderkey"]).select("o_orderkey", "group_key", "batch")


@query
def lr_schedule(r: Relations) -> DataFrame:
    """The rate at each order's step."""
    step = F.col("o_orderkey") % 1200
    return r.table("orders").select("o_orderkey", r6(C.cosine_schedule(step, 100, 1000, 0.01, 0.001), "rate"))


# --- streams


@query
def stream_stats(r: Relations) -> DataFrame:
    """The batch result that the stream of the same table must reach; tests run both."""
    from glimmer.streaming import online

    return online.finished(online.running_stats(r.table("events"), "event_type", "value"), "event_type").select("event_type", "n", F.round("mean", 5).alias("mean"), F.round("variance", 4).alias("variance"))


@query
def windowed_activity(r: Relations) -> DataFrame:
    from glimmer.streaming import online

    return online.windowed_counts(r.table("events"), "ts", "event_type", "1 day")
