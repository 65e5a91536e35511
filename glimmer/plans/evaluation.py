"""Evaluations composed of the engine's operators, and queries for its sources, sinks, scalars and configurations. Each
has SQL of the same name in evaluation_oracle.py unless that module says why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions import columns as C
from glimmer.operators import encode, estimators, probe, ranking, relational, sparse, stats
from glimmer.plans import sweep
from glimmer.plans.catalog import QUERIES, groups, query, r6, relu_stats
from glimmer.plans.relations import CLASSES, FEATURES, TOKENS, Relations
from glimmer.sources import files, readers, store
from glimmer.streaming import online


def held_out() -> Column:
    """Whether an example is held out: every fifth is."""
    return F.col("example_idx") % 5 == 0


# --- summaries of codes


@query
def inference_summary(r: Relations) -> DataFrame:
    """What an inference run reports: reconstruction, sparsity and firing in one row."""
    recon = stats.recon_metrics(encode.reconstructed(r.acts, r.weights, [FEATURES])).select("n_tokens", r6("nmse"), r6("mse_per_dim"))
    return recon.crossJoin(stats.eval_summary(r.codes, relu_stats(r), r.n_rows).select(r6("l0"), r6("l1"), "n_dead", "n_almost_dead", "n_dense"))  # one row each


@query
def validation_summary(r: Relations) -> DataFrame:
    """The same over held-out examples only, with explained variance."""
    pairs = encode.reconstructed(r.acts.where(held_out()), r.weights, [FEATURES])
    codes = r.codes.where(held_out())
    n = r.acts.where(held_out()).count()
    sums = codes.agg((F.count_if(F.col("value") != 0) / n).alias("l0"), (F.sum("value") / n).alias("l1"))
    return stats.explained_variance(pairs).select(r6("explained")).crossJoin(sums.select(r6("l0"), r6("l1")))  # one row each


@query
def feature_gallery(r: Relations) -> DataFrame:
    """A row a feature: logarithms of frequency and mean value, and its examples, the best first."""
    top = sparse.topk_examples(r.codes, r.features, 8, TOKENS, distinct=True)
    listed = top.groupBy("feature").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "example_idx"))), lambda x: x["example_idx"].cast("string")), ",").alias("examples"))  # eight at most
    found = relu_stats(r).join(listed, "feature", "left")
    return found.select("feature", r6(C.safe_log10(F.col("sparsity")), "log10_freq"), r6(C.safe_log10(F.col("mean_value")), "log10_value"), F.coalesce("examples", F.lit("")).alias("examples"))


@query
def task_maxima(r: Relations) -> DataFrame:
    """The best AUROC of each feature over the classes, best first."""
    best = ranking.auroc(groups(r)).groupBy("feature").agg(F.max(F.round("auroc", 6)).alias("auroc"))
    return best.select("feature", "auroc", F.row_number().over(Window.orderBy(F.desc("auroc"), "feature")).alias("place"))  # one row a feature


@query
def proposal_audit(r: Relations) -> DataFrame:
    """Features among the first ten by firing or by sum: the best class of each by average precision."""
    s = relu_stats(r)
    taken = s.orderBy(F.desc("nnz"), "feature").limit(10).select("feature").union(s.orderBy(F.desc("sum"), "feature").limit(10).select("feature")).distinct()
    ap = ranking.tie_aware_ap(groups(r)).withColumn("ap", F.round("ap", 9)).join(F.broadcast(taken), "feature", "left_semi")  # twenty rows at most
    best = F.max_by(F.struct("class", "ap"), F.struct(F.col("ap"), -F.col("class")))
    return ap.groupBy("feature").agg(best.alias("b")).select("feature", "b.class", r6("b.ap", "ap"))


@query
def auc_of_yield(r: Relations) -> DataFrame:
    """Yield at four budgets, and its mean over them."""
    ap = ranking.tie_aware_ap(groups(r)).groupBy("feature").agg(F.max("ap").alias("ap"))
    order = relu_stats(r).select("feature", F.row_number().over(Window.orderBy(F.desc("nnz"), "feature")).alias("position"))  # one row a feature
    return ranking.mean_yield(ranking.yield_at_budgets(order.join(ap, "feature"), [3, 10, 30, 100], 0.2)).select(r6("auc_b"))


@query
def best_model_per_class(r: Relations) -> DataFrame:
    """Of single features as models, the one with the highest macro average precision over all classes but absent ones."""
    macro = ranking.tie_aware_ap(groups(r), undefined=None).groupBy("feature").agg(F.round(F.avg("ap"), 9).alias("macro_ap"))
    return macro.orderBy(F.desc("macro_ap"), "feature").limit(1).select("feature", r6("macro_ap"))


def example_labels(r: Relations) -> DataFrame:
    return stats.modal_label(r.acts, ["example_idx"]).select("example_idx", "label")


def example_classes(r: Relations) -> tuple[DataFrame, DataFrame, int]:
    """(row, class) of examples, (class, total), and how many there are."""
    own = example_labels(r).select(F.col("example_idx").alias("row"), F.col("label").alias("class"))
    totals = r.classes.join(own.groupBy("class").agg(F.count("*").alias("total")), "class", "left").fillna(0)
    return own, totals, own.count()


@query
def mimic_scores(r: Relations) -> DataFrame:
    """Max-pooled features of examples, scored for each class: AUROC, support and mean."""
    own, totals, n = example_classes(r)
    pooled = store.kept(sparse.pool(r.codes, TOKENS, "max").withColumnRenamed("example_idx", "row"))
    scores = ranking.auroc(ranking.tie_groups(pooled.select("row", "feature", "value"), own, r.features, n, totals))
    support = sparse.support_by_class(pooled.select("row", "feature", "value"), own.withColumnRenamed("class", "label")).withColumnRenamed("label", "class")
    return scores.join(support, ["feature", "class"], "left").select("feature", "class", r6("auroc"), r6(F.coalesce("support", F.lit(0.0)), "support"), r6(F.coalesce("mean_act", F.lit(0.0)), "mean_act")).where("auroc is not null")


@query
def task_f1_sum_pooled(r: Relations) -> DataFrame:
    """F1 of "sum-pooled feature above a threshold" for each class of examples."""
    own, totals, n = example_classes(r)
    pooled = sparse.pool(r.codes, TOKENS, "sum").withColumnRenamed("example_idx", "row")
    counts = ranking.confusion(pooled.select("row", "feature", "value"), own, r.features, totals, n, [0.0, 0.5])
    return ranking.prf1(counts).select("feature", "class", r6("tau"), r6("f1"))


@query
def first_label_f1(r: Relations) -> DataFrame:
    """F1 of "feature fires" on examples whose smallest non-null label (0 is null) has more than a fourth of the tokens."""
    counts = r.acts.groupBy("example_idx", "label").agg(F.count("*").alias("n"))
    first = counts.where("label <> 0").groupBy("example_idx").agg(F.min_by(F.struct("label", "n"), "label").alias("f")).select("example_idx", "f.*")
    own = first.where(F.col("n") > 0.25 * TOKENS).select(F.col("example_idx").alias("row"), F.col("label").alias("class"))
    totals = r.classes.join(own.groupBy("class").agg(F.count("*").alias("total")), "class", "left").fillna(0)
    fired = sparse.pool(r.codes, TOKENS, "max").withColumnRenamed("example_idx", "row").join(own.select("row"), "row", "left_semi")
    return ranking.prf1(ranking.confusion(fired.select("row", "feature", "value"), own, r.features, totals, own.count(), [0.0])).select("feature", "class", "tp", "fp", "fn", r6("f1"))


@query
def classifier_summary(r: Relations) -> DataFrame:
    """Of each class: rules that say yes where any of the k features of highest AUROC exceeds 0.1; the best balanced
    accuracy, the fewest features within nine tenths of it, and the best single feature."""
    scored = ranking.auroc(groups(r)).withColumn("auroc", F.round("auroc", 9))
    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("auroc"), "feature"))).where("place <= 8")  # one row a feature
    fired = r.codes.where("value > 0.1").select("row", "feature").join(F.broadcast(placed.select("feature", "class", "place")), "feature")
    first = fired.groupBy("row", "class").agg(F.min("place").alias("place")).join(r.labels, "row")
    ks = F.explode(F.array(*(F.lit(k) for k in (1, 2, 4, 8))))
    said = first.select("class", "label", "place", ks.alias("k")).where("place <= k").groupBy("class", "k").agg(F.count_if(F.col("label") == F.col("class")).alias("tp"), F.count_if(F.col("label") != F.col("class")).alias("fp"))
    grid = r.n_positive.select("class", "total", ks.alias("k")).join(said, ["class", "k"], "left").fillna(0).where(f"total > 0 and total < {r.n_rows}")
    balanced = grid.withColumn("acc", F.round((F.col("tp") / F.col("total") + 1 - F.col("fp") / (F.lit(r.n_rows) - F.col("total"))) / 2, 9))
    best = balanced.groupBy("class").agg(F.max("acc").alias("best"))
    few = balanced.join(best, "class").where(F.col("acc") >= 0.9 * F.col("best")).groupBy("class").agg(F.min("k").alias("few"), F.max("best").alias("best"))
    return few.join(placed.where("place = 1").select("class", F.col("feature").alias("single")), "class").select("class", r6("best"), "few", "single")


# --- probes


@query
def probe_inputs(r: Relations) -> DataFrame:
    """The checks before a probe is fitted, against two files of labels, one whole and one that lacks some: rows on either
    side, classes as the largest label plus one, and whether each vector has its label."""
    out = None
    for name, lack in (("whole", F.lit(False)), ("torn", F.col("row") % 50 == 7)):
        labels = store.kept(r.labels.where(~lack).repartition(3))
        met = r.acts.select("row", held_out().alias("test")).join(labels, "row", "left")
        found = met.agg(F.count("*").alias("n_vectors"), (F.max("label") + 1).cast("long").alias("n_classes"), F.count("label").alias("n_labels"), F.count_if("test").alias("n_test"), F.count_if(~F.col("test")).alias("n_train"))
        found = found.select(F.lit(name).alias("file"), "*", (F.col("n_vectors") == F.col("n_labels")).alias("equal"))
        out = found if out is None else out.unionByName(found)
    return out


def probe_side(r: Relations, test: bool) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(codes, positives, priors, rows) of the training or held-out examples."""
    kept = held_out() if test else ~held_out()
    acts = r.acts.where(kept)
    n = acts.count()
    totals = r.classes.join(acts.groupBy(F.col("label").alias("class")).agg(F.count("*").alias("total")), "class", "left").fillna(0)
    return r.codes.where(kept).select("row", "feature", "value"), acts.select("row", F.col("label").alias("class")), probe.priors(totals, n), n


@query
def probe_report(r: Relations) -> DataFrame:
    """Probes fitted on the training examples until they stand still; of each class the feature with the least training
    loss, its loss, and its probe's precision, recall and F1 at the class's share on held-out examples."""
    codes, labels, base, n = probe_side(r, test=False)
    fitted = probe.fit_probes(codes, labels, r.features, base, sparse.rms_scale(codes, r.features), n, 25, store.scratch(r.spark, "probes"))
    best = store.kept(fitted.groupBy("class").agg(F.min_by(F.struct("feature", "b", "w", "loss"), F.struct(F.round("loss", 9), F.col("feature"))).alias("p")).select("class", "p.*"))
    held, positives, prior, m = probe_side(r, test=True)
    own = held.join(F.broadcast(best), "feature").join(positives.withColumnRenamed("class", "label"), "row")  # one row a class
    shares = base.select("class", "mean")
    says = C.sigmoid(F.col("b") + F.col("w") * F.col("value")) > F.col("mean")
    sums = own.join(F.broadcast(shares), "class").groupBy("class").agg(F.count("*").alias("nnz"), F.count_if(F.col("label") == F.col("class")).alias("pos"), F.count_if(says & (F.col("label") == F.col("class"))).alias("a"), F.count_if(says & (F.col("label") != F.col("class"))).alias("c"))
    full = best.join(sums, "class", "left").fillna(0).join(shares, "class").join(prior.select("class", "total"), "class")
    at_zero = F.when(C.sigmoid(F.col("b")) > F.col("mean"), 1).otherwise(0)
    tp = F.col("a") + at_zero * (F.col("total") - F.col("pos"))
    fp = F.col("c") + at_zero * (F.lit(m) - F.col("nnz") - F.col("total") + F.col("pos"))
    counts = full.select("class", "feature", "loss", tp.alias("tp"), fp.alias("fp"), (F.col("total") - tp).alias("fn"))
    return ranking.prf1(counts).select("class", "feature", r6("loss"), r6("precision"), r6("recall"), r6("f1"))


@query
def purity_at_budgets(r: Relations) -> DataFrame:
    """Purity of the 16, 64 and 256 top rows of each feature."""
    top = store.kept(sparse.topk_per_feature(r.codes, r.features, 256))
    found = None
    for k in (16, 64, 256):
        own = ranking.purity_at_k(top.where(F.col("rank") <= k), r.labels, k).select("feature", F.lit(k).alias("k"), r6("purity"))
        found = own if found is None else found.unionByName(own)
    return found


@query
def baseline_run(r: Relations) -> DataFrame:
    """A baseline from the shuffled scan: three passes of k-means over batches, then its measures, by method."""
    shuffled = store.kept(store.shuffled_scan(r.acts, 5, ["row"]).withColumn("batch", F.expr("conv(substring(shuffle_key, 1, 1), 16, 10) div 4")))
    methods = {"kmeans": estimators.KMeans(r.weights.dec[:8])}
    rows = []
    for name, fitted in methods.items():
        for batch in range(4):
            fitted = fitted.partial_fit(shuffled.where(F.col("batch") == batch))
        found = fitted.evaluate(r.acts).first()
        rows.append((name, float(found["inertia"]), float(found["utilisation"])))
    return r.spark.createDataFrame(rows, "method string, inertia double, utilisation double").select("method", r6("inertia"), r6("utilisation"))


@query
def edit_report(r: Relations) -> DataFrame:
    """Vectors with a feature set to 0.5, assigned to the nearest of eight centres before and after: which change."""
    centres = estimators.KMeans(r.weights.dec[:8])
    before = centres.assign(r.acts).select("row", F.col("center").alias("before"))
    moved = encode.edited(r.acts.select("row", "act"), r.codes, r.weights, 3, 0.5)
    after = centres.assign(moved).select("row", F.col("center").alias("after"))
    return stats.intervention_report(before.join(after, "row"), 3).select(r6("target_changed"), r6("other_changed"))


@query
def centre_accuracy(r: Relations) -> DataFrame:
    """Centres as classifiers: each says its most frequent label. Accuracy over rows, and balanced over classes."""
    near = estimators.KMeans(r.weights.dec[:8]).assign(r.acts).join(r.labels, "row").select("center", "label")
    says = stats.modal_label(near, ["center"]).select("center", F.col("label").alias("pred"))
    guesses = near.join(F.broadcast(says), "center").withColumn("model", F.lit("centres"))  # eight rows
    return stats.accuracies(guesses, ["model"]).select("model", r6("accuracy"), r6("balanced"), r6("majority"))


@query
def centre_iou(r: Relations) -> DataFrame:
    """Mean IoU over the classes that occur, and the share of rows that are right, of the same classifier."""
    near = estimators.KMeans(r.weights.dec[:8]).assign(r.acts).join(r.labels, "row").select("center", "label")
    says = stats.modal_label(near, ["center"]).select("center", F.col("label").alias("pred"))
    guesses = near.join(F.broadcast(says), "center").withColumn("model", F.lit("centres"))
    iou = stats.class_iou(guesses, r.classes.select(F.col("class").alias("label"))).groupBy("model").agg(F.avg("iou").alias("mean_iou"))
    right = guesses.groupBy("model").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("pixel_accuracy"))
    return iou.join(right, "model").select("model", r6("mean_iou"), r6("pixel_accuracy"))


@query
def pure_patch_summary(r: Relations) -> DataFrame:
    """Mean, most and fewest pure patches of a class."""
    shares = stats.modal_share(r.acts.withColumn("label", F.col("label") % 3), ["example_idx"])
    counts = stats.pure_counts(shares, r.classes.where("class < 3").select(F.col("class").alias("label")), 0.75)
    return counts.agg(r6(F.avg("n"), "mean_n"), F.max("n").alias("max_n"), F.min("n").alias("min_n"))


# --- losses and prefixes


@query
def scaled_mse(r: Relations) -> DataFrame:
    """Mean squared error with both sides divided by the largest number of the row, times its square again."""
    pairs = encode.reconstructed(r.acts, r.weights, [FEATURES]).select("row", "x", "x_hat", F.array_max(F.transform("x", lambda v: F.abs(v.cast("double")))).alias("top"))
    scaled = F.zip_with("x", "x_hat", lambda a, b: (a.cast("double") / F.col("top") - b / F.col("top")) * (a.cast("double") / F.col("top") - b / F.col("top")))
    return pairs.select((F.aggregate(scaled, F.lit(0.0), lambda s, v: s + v) / F.size("x") * F.col("top") * F.col("top")).alias("e")).agg(r6(F.avg("e"), "mse"))


@query
def prefix_draws(r: Relations) -> DataFrame:
    """Four prefixes of 32 features for each supplier's draw, without replacement, heavier for short ones: the least exponential keys
    -ln(u) / w with u from a hash; the last prefix is all features."""
    draws = r.table("supplier").select(F.col("s_suppkey").alias("draw"))
    grid = draws.select("draw", F.explode(F.sequence(F.lit(1), F.lit(FEATURES - 1))).alias("prefix"))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", "draw", "prefix")), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    keyed = grid.withColumn("key", F.round(-F.log(u) / F.pow(F.col("prefix"), F.lit(-1.5)), 9))
    drawn = keyed.withColumn("place", F.row_number().over(Window.partitionBy("draw").orderBy("key", "prefix"))).where("place <= 3").select("draw", "prefix")
    return drawn.unionByName(draws.select("draw", F.lit(FEATURES).alias("prefix")))


# --- sources and sinks


@query
def scan_counts(r: Relations) -> DataFrame:
    """Vectors of scans of content, special and all tokens of two layers, as the layout says and as counted."""
    layout = store.Layout(TOKENS, False, (0, 1), 64, r.n_rows // TOKENS, 200)
    made = r.acts.where(F.col("row") < layout.examples * TOKENS).select("token_idx", F.explode(F.array(F.lit(0), F.lit(1))).alias("layer"))
    counted = made.agg(F.count("*").alias("all"), F.count_if(F.col("token_idx") >= 0).alias("content"), F.count_if(F.col("token_idx") == -1).alias("special")).select(F.expr("stack(3, 'all', `all`, 'content', content, 'special', special) as (kind, counted)"))
    said = r.spark.createDataFrame([(k, layout.rows(k, 2)) for k in ("content", "special", "all")], "kind string, expected long")
    return said.join(counted, "kind").select("kind", "expected", "counted")


@query
def layer_token_scan(r: Relations) -> DataFrame:
    """One layer's content tokens of a store of two layers with special tokens."""
    special = r.acts.where("token_idx = 0").withColumn("token_idx", F.lit(-1).cast("long"))
    both = r.acts.unionByName(special).select("example_idx", "token_idx", "label", "act", F.explode(F.array(F.lit(3), F.lit(7))).alias("layer"))
    scan = store.ordered_scan(both, layer=7, tokens="content")
    return scan.groupBy("label").agg(F.count("*").alias("n"), F.max("example_idx").alias("last"))


@query
def labelled_scan(r: Relations) -> DataFrame:
    """Vectors beside labels from a relation of their own; a token without one is marked by -1."""
    labels = r.acts.where(F.col("row") % 3 != 0).select("example_idx", "token_idx", F.col("label").alias("token_label"))
    return store.ordered_scan(r.acts.select("row", "example_idx", "token_idx", "act"), labels).select("row", F.coalesce("token_label", F.lit(-1)).alias("token_label"))


@query
def store_roundtrip(r: Relations) -> DataFrame:
    """A store written by layer and shard, and its manifest, against the counts that its layout says."""
    layout = store.Layout(TOKENS, False, (0,), 64, r.n_rows // TOKENS, 200)
    manifest = store.write_store(r.acts.where(F.col("row") < layout.examples * TOKENS).select("example_idx", "token_idx", F.lit(0).alias("layer"), "act"), layout, store.scratch(r.spark, "store"))
    expected = F.least(F.lit(layout.examples_per_shard), F.lit(layout.examples) - F.col("shard_idx") * layout.examples_per_shard)
    return manifest.select(F.col("shard_idx").cast("long").alias("shard_idx"), "n_examples", (F.col("n_examples") == expected).alias("as_said"))


@query
def codes_roundtrip(r: Relations) -> DataFrame:
    """Codes written as Parquet by range of rows, and the statistics of what is read again."""
    path = store.scratch(r.spark, "codes")
    r.codes.select("row", "feature", "value").write.parquet(path)
    back = r.spark.read.parquet(path)
    return back.groupBy("feature").agg(F.count("*").alias("nnz"), r6(F.sum("value"), "sum"))


@query
def csv_roundtrip(r: Relations) -> DataFrame:
    """A report written as CSV with a header and read by its schema."""
    path = store.scratch(r.spark, "csv")
    r.table("nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 4 == 0, F.lit(None).cast("string")).otherwise(F.lit("x")).alias("mark")).write.option("header", True).option("nullValue", "?").csv(path)
    return readers.read_csv(r.spark, path, "n_nationkey int, n_name string, mark string")


@query
def manifest_roundtrip(r: Relations) -> DataFrame:
    """Files with the digests of their contents as one manifest of JSON lines in order, read again."""
    path, folder = store.scratch(r.spark, "manifest"), store.scratch(r.spark, "files")
    made = r.table("supplier").select(F.concat("s_name", F.lit(".txt")).alias("name"), F.concat_ws("\n", "s_name", F.col("s_nationkey").cast("string")).cast("binary").alias("content"))
    readers.write_manifest(store.kept(files.written_files(made, folder)), path, ["name"])
    said = r.spark.read.schema("name string, bytes long, sha256 string").json(path)
    return files.checked_files(said, folder).join(said.select("name", "sha256"), "name")


@query
def file_checks(r: Relations) -> DataFrame:
    """Files of a folder against a manifest: all faults in one table."""
    folder, key = store.scratch(r.spark, "files"), F.col("n_nationkey")
    name, text = F.concat("n_name", F.lit(".txt")), F.col("n_name")
    made = r.table("nation").where(key % 6 != 1).select(F.when(key % 6 == 5, F.concat("n_name", F.lit(".dir"))).otherwise(name).alias("name"), F.when(key % 6 == 2, F.lit("")).otherwise(text).cast("binary").alias("content"))
    files.written_files(made, folder).count()
    said = r.table("nation").select(F.when(key % 6 == 5, F.lit(".")).otherwise(name).alias("name"), F.when(key % 6 == 3, F.length(text) + 1).otherwise(F.length(text)).cast("long").alias("bytes"), F.when(key % 6 == 4, F.sha2(F.reverse(text).cast("binary"), 256)).otherwise(F.sha2(text.cast("binary"), 256)).alias("sha256"))
    return files.checked_files(said, folder).groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


@query
def resumed_work(r: Relations) -> DataFrame:
    """Orders that a sink of earlier results lacks."""
    done = r.table("lineitem").where("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return readers.pending(r.table("orders").select("o_orderkey", "o_orderstatus"), done, ["o_orderkey"])


@query
def conditional_labels(r: Relations) -> DataFrame:
    """Labels are written only where there are any: of each language, whether a table was made, and its rows."""
    rows = []
    both = store.kept(r.table("documents").join(r.table("labels").where("toxic = 1"), "doc_id").select("doc_id", "lang"))
    for lang in ("de", "en", "xx"):
        own = both.where(F.col("lang") == lang)
        made = not own.isEmpty()
        path = store.scratch(r.spark, f"labels-{lang}")
        if made:
            own.write.parquet(path)
        rows.append((lang, made, r.spark.read.parquet(path).count() if made else 0))
    return r.spark.createDataFrame(rows, "lang string, made boolean, n long")


@query
def checkpoint_roundtrip(r: Relations) -> DataFrame:
    """Weights as a relation with their layout as JSON beside them, written and read; the sizes of decoder rows."""
    path = store.scratch(r.spark, "weights")
    store.write_weights(r.spark, r.weights, path, {"kind": "tied", "schema": 5})
    header, weights = store.read_weights(r.spark, path)
    rows = [(i, header["kind"], float(sum(x * x for x in dec) ** 0.5)) for i, dec in enumerate(weights.dec)]
    return r.spark.createDataFrame(rows, "feature int, kind string, size double").select("feature", "kind", r6("size"))


@query
def artifact_set(r: Relations) -> DataFrame:
    """The five tables of an inference run: what a first call writes, what a second does, and what metrics only does."""
    folder = store.scratch(r.spark, "artifacts")
    found = relu_stats(r)
    frames = {"codes": r.codes, "features": found, "top": sparse.topk_per_feature(r.codes, r.features, 4), "metrics": stats.eval_summary(r.codes, found, r.n_rows), "labels": r.labels}
    first, second = readers.write_artifacts(frames, folder), readers.write_artifacts(frames, folder)
    third = readers.write_artifacts(frames, folder, force=True, only="metrics")
    rows = [(name, name in first, name in second, name in third, r.spark.read.parquet(f"{folder}/{name}").count()) for name in frames]
    return r.spark.createDataFrame(rows, "name string, first boolean, second boolean, metrics_only boolean, n long")


@query
def codes_transform(r: Relations) -> DataFrame:
    """Codes by a transform that is registered here: the values of a row above its mean."""
    if "above_mean" not in encode.TRANSFORMS:
        encode.transform("above_mean")(lambda h, k, threshold: (h > h.mean(axis=1, keepdims=True) + 0.05).nonzero())
    return r.codes_of("above_mean").groupBy("feature").agg(F.count("*").alias("n"), r6(F.sum("value"), "sum"))


@query
def stem_join(r: Relations) -> DataFrame:
    """Images, masks and a label table joined by the stem of their file names, each label column numbered by its sorted
    values."""
    images = r.table("documents").select(F.format_string("/images/%s/doc_%d.jpg", "lang", "doc_id").alias("path"))
    masks = r.table("documents").where("doc_id % 2 = 0").select(F.format_string("/masks/doc_%d.png", "doc_id").alias("path"))
    table = r.table("documents").select(F.format_string("doc_%d", "doc_id").alias("stem"), "lang", "source")
    return store.stem_join(images, masks, table, ["lang", "source"]).select("stem", "lang", "lang_id", "source", "source_id")


@query
def taxonomy_source(r: Relations) -> DataFrame:
    """Recordings whose label belongs to a class of the taxonomy."""
    taxonomy = r.table("nation").join(r.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'ASIA'").select(F.col("n_nationkey").alias("c_nationkey"))
    return r.table("customer").join(taxonomy, "c_nationkey", "left_semi").select("c_custkey", "c_nationkey")


@query
def many_labels(r: Relations) -> DataFrame:
    """Examples with one column a label, each also as the number of its sorted values."""
    docs = r.table("documents").select("doc_id", "lang", "source")
    return store.numbered(store.numbered(docs, "lang"), "source").select("doc_id", "lang_id", "source_id")


@query
def many_roots(r: Relations) -> DataFrame:
    """Class folders below two roots as one source: targets by the sorted classes of both."""
    paths = r.table("documents").select(F.format_string("/root%d/%s/doc_%d.PNG", (F.col("doc_id") % 2).cast("int"), "lang", "doc_id").alias("path"))
    both = paths.where("path like '/root0/%'").unionByName(paths.where("path like '/root1/%'"))
    return store.image_folder(both).groupBy("label", "target").agg(F.count("*").alias("n"))


@query
def doubled_stems(r: Relations) -> DataFrame:
    """Stems that occur twice, which a source must not hold."""
    lines = r.table("documents").select(F.format_string("%s_%d of %s %s", "lang", (F.col("doc_id") % 50).cast("int"), "source", "lang").alias("value"))
    stems = store.label_lines(lines)
    return stems.groupBy("stem").agg(F.count("*").alias("n")).where("n > 1")


# --- relational


@query
def checked_lookup(r: Relations) -> DataFrame:
    """Each order with its customer's segment; an order without a customer would be an error."""
    return relational.checked_join(r.table("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), r.table("customer").select("c_custkey", "c_mktsegment"), ["c_custkey"]).select("o_orderkey", "c_mktsegment")


@query
def chosen_columns(r: Relations) -> DataFrame:
    return relational.columns_like(r.table("part"), r"p_(partkey|size|brand)")


@query
def not_nan_filter(r: Relations) -> DataFrame:
    """Numbers that are there and above a threshold, the first rows by key."""
    made = r.table("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).when(F.col("l_linenumber") == 5, F.lit(None)).otherwise(F.col("l_quantity").cast("double")).alias("x"))
    return made.where(~F.isnan("x") & F.col("x").isNotNull() & (F.col("x") > 40)).orderBy("l_orderkey", "l_linenumber").limit(100).select("l_orderkey", "l_linenumber", r6("x"))


# --- scalars


@query
def view_parts(r: Relations) -> DataFrame:
    """Keys "left:right" taken apart, and whether two named parts of a word are the same."""
    made = r.table("part").select("p_partkey", F.concat_ws(":", "p_brand", "p_type").alias("key"), F.concat_ws("-vs-", "p_brand", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.lit("other"))).alias("pair"))
    left, right = C.two_sides(F.col("key"))
    same = F.regexp_extract("pair", "^(.+)-vs-(.+)$", 1) == F.regexp_extract("pair", "^(.+)-vs-(.+)$", 2)
    return made.select("p_partkey", left.alias("left"), right.alias("right"), same.alias("same"))


@query
def keyword_flags(r: Relations) -> DataFrame:
    """Keywords in any case, a hyphen for a hyphen or white space, and ranges of numbers with unknown ends."""
    made = r.table("part").select("p_partkey", F.concat_ws(" ", F.when(F.col("p_partkey") % 2 == 0, F.lit("Semi Aquatic")).otherwise(F.lit("semi-aquatic")), "p_name").alias("text"), F.concat(F.when(F.col("p_partkey") % 5 == 0, F.lit("?")).otherwise(F.col("p_size").cast("string")), F.lit(" - "), (F.col("p_size") + 3).cast("string"), F.lit(" cm")).alias("span"))
    low, high = C.numeric_range(F.col("span"))
    return made.select("p_partkey", C.keyword(F.col("text"), "semi-aquatic").alias("named"), C.keyword(F.col("text"), "aqua").alias("part_only"), low.alias("low"), high.alias("high"))


@query
def label_line_parts(r: Relations) -> DataFrame:
    """Lines "stem label" taken apart at the last space."""
    lines = r.table("part").select("p_partkey", F.concat_ws(" ", "p_name", F.regexp_replace("p_brand", " ", "_")).alias("line"))
    before, after = C.last_space_split(F.col("line"))
    return lines.select("p_partkey", before.alias("before"), after.alias("after"))


@query
def byte_sizes(r: Relations) -> DataFrame:
    made = r.table("supplier").select("s_suppkey", (C.power(F.col("s_suppkey").cast("double"), F.lit(4.0)) * 1e6).alias("n"))
    return made.select("s_suppkey", C.human_bytes(F.col("n")).alias("size"))


@query
def recent_events(r: Relations) -> DataFrame:
    """Events from a time on, by day."""
    t = r.table("events")
    return t.where(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp")).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query
def close_values(r: Relations) -> DataFrame:
    """Equality up to a tolerance, for numbers, NaN and null."""
    x = F.when(F.col("s_suppkey") % 4 == 0, F.lit(float("nan"))).when(F.col("s_suppkey") % 4 == 1, F.lit(None).cast("double")).otherwise(F.col("s_acctbal"))
    y = F.when(F.col("s_suppkey") % 8 == 2, x * 1.01).when(F.col("s_suppkey") % 8 == 3, x * (1 + 1e-7)).when(F.col("s_suppkey") % 8 == 4, F.lit(1.0)).otherwise(x)
    return r.table("supplier").select("s_suppkey", C.close(x, y).alias("equal"))


# --- configurations


@query
def config_precedence(r: Relations) -> DataFrame:
    """Command over sweep over default, field by field, of each nation's configuration; and the fields no default knows."""
    key = F.col("n_nationkey")
    default = F.create_map(F.lit("lr"), F.lit("0.1"), F.lit("model.k"), F.lit("8"))
    over = F.map_filter(F.create_map(F.lit("lr"), F.when(key % 2 == 0, "0.5"), F.lit("model.k"), key.cast("string")), lambda k, v: v.isNotNull())
    top = F.map_filter(F.create_map(F.lit("lr"), F.when(key % 3 == 0, "0.9"), F.lit("typo"), F.when(key % 5 == 0, "1")), lambda k, v: v.isNotNull())
    config, unknown = sweep.merged_maps(default, over, top)
    return r.table("nation").select("n_nationkey", config["lr"].alias("lr"), config["model.k"].alias("k"), F.array_join(unknown, ",").alias("unknown"))


@query
def seeded_grid(r: Relations) -> DataFrame:
    """The configurations of suppliers, whose seeds count up from 7 in order."""
    places = relational.ranked(r.table("supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("lr")), [F.col("s_suppkey")])
    return places.select("s_suppkey", "lr", (F.col("place") + 6).alias("seed"))


@query
def config_changes(r: Relations) -> DataFrame:
    """The fields of each customer's configuration that are not the default's."""
    configs = r.table("customer").select("c_custkey", (F.col("c_custkey") % 3).alias("lr"), F.col("c_mktsegment").alias("model.kind"), (F.col("c_nationkey") > 12).alias("model.tied"))
    return sweep.changed_fields(configs, "c_custkey", {"lr": 1, "model.kind": "BUILDING", "model.tied": True})


@query
def ordered_config(r: Relations) -> DataFrame:
    """The scan in order that belongs to each supplier's shuffled scan: its fields without those of the shuffle."""
    key = F.col("s_suppkey").cast("string")
    made = F.create_map(F.lit("layer"), F.col("s_nationkey").cast("string"), F.lit("seed"), key, F.lit("tokens"), F.col("s_name"), F.lit("buffer"), key, F.lit("workers"), key)
    return r.table("supplier").select("s_suppkey", F.explode(sweep.ordered_map(made)).alias("field", "value"))


# --- streams


@query
def dead_from_state(r: Relations) -> DataFrame:
    """The dead mask from the state that a stream of codes keeps, here over the whole table."""
    state = r.codes_of("jump", threshold=0.4).groupBy("feature").agg(F.max("row").alias("last"), F.count("*").alias("fired"))
    return online.dead_by_state(state, r.features, r.n_rows, 100).select("feature", "since", "dead")


@query
def stochastic_percentile(r: Relations) -> DataFrame:
    """The estimate of the ninetieth percentile of each type's values, one step an event, in order."""
    return online.percentile_by_key(r.table("events"), "event_type", "event_id", "value", 90.0, 5.0).select("event_type", "n", r6("estimate"))


@query
def threshold_average(r: Relations) -> DataFrame:
    """The moving average of each batch's least kept value, in the order of batches."""
    least = encode.batch_topk(r.codes_of("all"), 4, 50).groupBy("batch").agg(F.min("value").alias("least"))
    return online.decayed_average(least, [F.col("batch")], "least", 0.9).select(r6("average", "threshold"))


def rate(step: Column) -> Column:
    return C.linear_warmup(step, 100, 0.01)


@query
def warmup_schedule(r: Relations) -> DataFrame:
    """The rate at each part's step."""
    return r.table("part").select("p_partkey", r6(rate(F.col("p_partkey") % 300), "rate"))


__all__ = ["QUERIES", "CLASSES"]
