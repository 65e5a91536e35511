"""Queries for sinks, files, strict records and ordered streams, and for probes judged on held-out rows. Each has SQL of the
same name below, but for probe_metrics (probes fitted until they stand still); a test compares its measures with numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions import columns as C
from glimmer.operators import encode, ordered, probe, ranking, sparse, stats
from glimmer.plans import baselines  # noqa: F401  (its query)
from glimmer.plans.catalog import groups, query, r6
from glimmer.plans.evaluation import held_out, probe_side
from glimmer.plans.oracle import TIES, on_base, recon
from glimmer.plans.relations import CLASSES, DIMS, FEATURES, TOKENS, Relations
from glimmer.sources import checkpoints, shards, store

CAPACITY = 300


@query
def csr_roundtrip(r: Relations) -> DataFrame:
    """Codes written as sparse shards by several tasks, and the statistics of what is read again, by shard."""
    path = store.scratch(r.spark, "csr")
    shards.write_csr(r.codes, path, r.n_rows, FEATURES, CAPACITY)
    back = shards.read_csr(r.spark, path)
    return back.groupBy(F.expr(f"row div {CAPACITY}").alias("shard"), "feature").agg(F.count("*").alias("nnz"), r6(F.round(F.sum("value"), 3), "sum"))


@query
def raw_roundtrip(r: Relations) -> DataFrame:
    """Vectors written as raw float32 shards, and what the reader of such shards finds, by shard."""
    path = store.scratch(r.spark, "raw")
    shards.write_raw(r.acts.select("row", "act"), path, r.n_rows, DIMS, CAPACITY)
    files = shards.shard_manifest(path)["shards"]
    folder = path.removeprefix("file://")
    r.spark.dataSource.register(store.FloatShards)
    back = r.spark.read.format("float_shards").options(paths=",".join(f"{folder}/{f['name']}" for f in files), dims=DIMS).load()
    total = F.aggregate("act", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), r6(F.round(F.sum(total), 3), "sum"))


@query
def zipped_streams(r: Relations) -> DataFrame:
    """Activations zipped with a file of labels by example and token, each position checked; sums by label."""
    path = store.scratch(r.spark, "labels")
    r.acts.select("example_idx", "token_idx", F.col("label").alias("told")).repartition(3).write.parquet(path)
    sums = F.aggregate("act", F.lit(0.0), lambda s, x: s + x.cast("double"))
    both = ordered.zipped(r.acts.select("example_idx", "token_idx", sums.alias("total")), r.spark.read.parquet(path), ["example_idx", "token_idx"])
    return both.groupBy("told").agg(F.count("*").alias("n"), r6(F.sum("total"), "total"))


#: Headers of all schemas for one model, by file.
HEADERS = {
    "none": {"d_vit": DIMS, "exp_factor": 1, "seed": 3, "l1_coeff": 0.1},
    "1a": {"schema": 1, "cls": "BatchTopK", "cfg": {"d_model": DIMS, "d_sae": FEATURES, "top_k": 8, "n_reinit_samples": 2}},
    "1b": {"schema": 1, "cls": "SparseAutoencoderConfig", "cfg": {"d_model": DIMS, "d_sae": FEATURES, "activation": {"cls": "TopK", "params": {"top_k": 16}}}},
    "3": {"schema": 3, "cfg": {"d_model": DIMS, "d_sae": FEATURES, "seed": 5, "activation": {"cls": "TopK", "params": {"top_k": 4, "kind": "x"}}}},
    "5": {"schema": 5, "cfg": {"d_model": DIMS, "d_sae": FEATURES, "activation": {"cls": "Relu", "params": {}}}},
}


@query
def checkpoint_files(r: Relations) -> DataFrame:
    """The weights as files of five schemas, read as one relation: what each header means, and the size of each part."""
    arrays = {"W_enc": np.asarray(r.weights.enc).T, "W_dec": np.asarray(r.weights.dec), "b_enc": np.asarray(r.weights.bias_enc), "b_dec": np.asarray(r.weights.bias_dec)}
    twice = {**arrays, "W_enc": np.c_[arrays["W_enc"], arrays["W_enc"]], "W_dec": np.r_[arrays["W_dec"], arrays["W_dec"]], "b_enc": np.r_[arrays["b_enc"], arrays["b_enc"]]}
    files = [(f"{name}.pt", bytearray(checkpoints.checkpoint_bytes(header, twice if name == "none" else arrays))) for name, header in HEADERS.items()]
    path = store.scratch(r.spark, "checkpoints")
    checkpoints.write_checkpoints(r.spark.createDataFrame(files, "name string, content binary"), path)
    rows = checkpoints.read_checkpoints(r.spark, path).where("part in ('enc', 'dec')")
    squares = F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x)
    return rows.groupBy("schema", "activation", F.coalesce("top_k", F.lit(0)).alias("top_k"), "d_sae", "part").agg(F.count("*").alias("n_rows"), r6(F.sum(squares), "squares"))


@query
def strict_metrics(r: Relations) -> DataFrame:
    """Records of metrics as JSON, good and bad ones, read strictly: the reason of each bad one."""
    k = F.col("s_suppkey")
    n, recon, base = k % 50 + 1, (k % 7).cast("double"), (k % 5 + 1).cast("double")
    fault = k % 9
    whole = F.when(fault == 1, "true").when(fault == 2, F.concat((n * 4).cast("string"), F.lit(".0"))).when(fault == 3, (n * 4 + 1).cast("string")).otherwise((n * 4).cast("string"))
    fields = {
        "n_tokens": n.cast("string"), "d_model": F.lit("4"), "n_elements": whole, "sse_recon": F.when(fault == 4, F.lit("-0.5")).when(fault == 5, F.lit('"1.0"')).otherwise(recon.cast("string")),
        "sse_baseline": base.cast("string"), "mse_per_dim": (recon / (n * 4)).cast("string"), "mse_per_token": (recon / n).cast("string"), "normalized_mse": F.when(fault == 6, F.lit("7.25")).otherwise((recon / base).cast("string")),
        "baseline_mse_per_dim": (base / (n * 4)).cast("string"), "baseline_mse_per_token": (base / n).cast("string"),
    }
    parts = [F.when((fault == 7) & F.lit(name == "sse_baseline"), F.lit(None).cast("string")).otherwise(F.concat(F.lit(f'"{name}":'), value)) for name, value in fields.items()]
    text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.when(fault == 8, F.lit("")).otherwise(F.lit("}")))
    found = stats.strict_metrics(r.table("supplier").select("s_suppkey", text.alias("record")), "record")
    return found.select("s_suppkey", F.when(F.col("reason").isNull(), F.col("n_tokens")).otherwise(0).alias("n_tokens"), F.when(F.col("reason").isNull(), r6("normalized_mse")).alias("nmse"), "reason")


@query
def canonical_hashes(r: Relations) -> DataFrame:
    """Of each customer the hash of a nested value, and whether it stays when its map is built in another order."""
    key, name = F.col("c_custkey"), F.col("c_name")
    made = r.table("customer").select(
        "c_custkey",
        F.struct(F.create_map(F.lit("name"), name, F.lit("key"), key.cast("string")).alias("m"), F.array(key, key % 3).alias("a"), F.when(key % 4 == 0, name).alias("s")).alias("x"),
        F.struct(F.create_map(F.lit("key"), key.cast("string"), F.lit("name"), name).alias("m"), F.array(key, key % 3).alias("a"), F.when(key % 4 == 0, name).alias("s")).alias("y"),
    )
    return made.select("c_custkey", C.canonical_hash(made, ["x"]).alias("sha256"), (C.canonical_hash(made, ["x"]) == C.canonical_hash(made, ["y"])).alias("same"))


def positions(test: bool) -> F.Column:
    """The place of a row among those of its side."""
    example, token = F.col("example_idx"), F.col("token_idx")
    place = F.expr("example_idx div 5") if test else example - F.expr("example_idx div 5") - 1
    return place * TOKENS + token


@query
def signed_probe_metrics(r: Relations) -> DataFrame:
    """Average precision, precision, recall and F1 on held-out rows of one given probe a class, half with negative weights.
    A probe says yes if its score, with bias 0.5, is over the class's cut; with 0.5 - cut as the bias, which is rounded,
    a score that equals the cut could pass."""
    held, positives, _, m = probe_side(r, test=True)
    best = r.classes.select("class", F.col("class").alias("feature"), F.lit(0.5).alias("b"), (F.col("class") / 20).alias("cut"), F.when(F.col("class") % 2 == 0, 1.0).otherwise(-1.0).alias("w"))
    found = probe.held_out_metrics(held.withColumn("value", F.round("value", 3)), positives, best, m)
    return found.select("class", "n_positive", *(r6(c) for c in ("ap", "precision", "recall", "f1")))


@query
def probe_metrics(r: Relations) -> DataFrame:
    """Probes fitted on the training examples until they stand still; of each class the feature with the least training
    loss, how its probe does on held-out rows, and the purity of the feature's top rows there."""
    labels = store.kept(r.acts.select("example_idx", "token_idx", "label"))  # a relation of its own
    rows = {}
    for test in (False, True):
        side = held_out() if test else ~held_out()
        own = labels.where(side).select(positions(test).alias("row"), "label")
        codes = r.codes.where(side).select(positions(test).alias("row"), "feature", "value")
        rows[test] = codes, own, r.acts.where(side).count()
    n_classes = probe.checked_side(*rows[False], FEATURES)
    probe.checked_side(*rows[True], FEATURES, n_classes)
    codes, own, n = rows[False]
    totals = r.spark.range(n_classes).select(F.col("id").cast("int").alias("class")).join(own.groupBy(F.col("label").alias("class")).agg(F.count("*").alias("total")), "class", "left").fillna(0)
    fitted = probe.fit_probes(codes, own.withColumnRenamed("label", "class"), r.features, probe.priors(totals, n), sparse.rms_scale(codes, r.features), n, 25, store.scratch(r.spark, "probes"))
    best = store.kept(probe.best_probes(fitted))
    codes, own, m = rows[True]
    found = probe.held_out_metrics(codes, own.withColumnRenamed("label", "class"), best, m).join(best.select("class", "loss"), "class")
    top = store.kept(sparse.topk_per_feature(codes, r.features, 256))
    for k in (16, 64, 256):
        found = found.join(ranking.purity_at_k(top.where(F.col("rank") <= k), own, k).select("feature", F.col("purity").alias(f"purity_{k}")), "feature", "left")
    return found.select("class", "feature", r6("loss"), "n_positive", *(r6(c) for c in ("ap", "precision", "recall", "f1")), *(r6(F.coalesce(f"purity_{k}", F.lit(0.0)), f"purity_{k}") for k in (16, 64, 256)))


@query
def validation_metrics(r: Relations) -> DataFrame:
    """What a validation run reports of held-out examples: errors of reconstruction, sparsity, and how many features are
    dead, almost dead or dense."""
    acts, codes = r.acts.where(held_out()), r.codes.where(held_out())
    n = acts.count()
    recon = stats.recon_metrics(encode.reconstructed(acts, r.weights, [FEATURES])).select("n_tokens", r6("nmse"), r6("mse_per_dim"))
    return recon.crossJoin(stats.eval_summary(codes, sparse.feature_stats(codes, r.features, n), n).select(r6("l0"), r6("l1"), "n_dead", "n_almost_dead", "n_dense"))  # one row each


@query
def validation_freqs(r: Relations) -> DataFrame:
    """How often each feature fires on held-out examples, and its mean value there."""
    found = sparse.feature_stats(r.codes.where(held_out()), r.features, r.acts.where(held_out()).count())
    return found.select("feature", r6("sparsity", "freq"), r6(F.coalesce("mean_value", F.lit(0.0)), "mean_value"))


@query
def audit_yields(r: Relations) -> DataFrame:
    """Of two rankings of features, the yield at each budget: the share of its first ones whose best class reaches an
    average precision of 0.2. Only features among the first ten of either are audited; all others count as not grounded."""
    told = sparse.feature_stats(r.codes, r.features, r.n_rows)
    orders = told.select("feature", F.explode(F.array(F.struct(F.lit("nnz").alias("ranking"), F.col("nnz").cast("double").alias("by")), F.struct(F.lit("sum").alias("ranking"), F.col("sum").alias("by")))).alias("x"))
    placed = orders.select("feature", "x.ranking", F.row_number().over(Window.partitionBy("x.ranking").orderBy(F.desc("x.by"), "feature")).alias("position"))  # a row a feature
    union = placed.where("position <= 10").select("feature").distinct()
    best = ranking.tie_aware_ap(groups(r).join(F.broadcast(union), "feature", "left_semi")).groupBy("feature").agg(F.max(F.round("ap", 9)).alias("ap"))  # twenty rows at most
    out = None
    for name in ("nnz", "sum"):
        own = placed.where(F.col("ranking") == name).join(best, "feature", "left")
        found = ranking.yield_at_budgets(own, [3, 10, 30], 0.2).select(F.lit(name).alias("ranking"), "budget", r6("yield"))
        out = found if out is None else out.unionByName(found)
    return out


@query
def concept_lookup(r: Relations) -> DataFrame:
    """Of each class but the background, the three features that tell it best by F1 over four thresholds, among patches of
    which one label holds at least half; features that fire on most rows are left out."""
    shares = r.acts.groupBy("example_idx", "label").agg(F.count("*").alias("n")).groupBy("example_idx").agg((F.max("n") / F.sum("n")).alias("share"))
    pure = store.kept(r.acts.select("row", "example_idx", "label").join(shares.where("share >= 0.5").select("example_idx"), "example_idx", "left_semi").select("row", "label"))
    totals = r.classes.join(pure.groupBy(F.col("label").alias("class")).agg(F.count("*").alias("total")), "class", "left").fillna(0)
    codes = r.codes.select("row", "feature", "value").join(pure.select("row"), "row", "left_semi")
    counts = ranking.prf1(ranking.confusion(codes, pure.withColumnRenamed("label", "class"), r.features, totals, pure.count(), [0.0, 0.1, 0.3, 1.0]))
    frequent = sparse.feature_stats(r.codes, r.features, r.n_rows).select("feature", "sparsity")
    best = counts.where("class > 0").groupBy("class", "feature").agg(F.max_by(F.struct(F.round("f1", 9).alias("f1"), "tau"), F.struct(F.round("f1", 9), -F.col("tau"))).alias("b"))
    allowed = best.join(F.broadcast(frequent), "feature").select("class", "feature", F.col("b.tau").alias("tau"), F.when(F.col("sparsity") < 0.6, F.col("b.f1")).otherwise(-1.0).alias("f1"))  # a row a feature
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("f1"), "feature"))
    return allowed.withColumn("place", place).where("place <= 3").select("class", "place", "feature", r6("tau"), r6("f1"))


def oracle_sql() -> dict[str, str]:
    """The DuckDB SQL of each query above that SQL can express."""
    return {
        "csr_roundtrip": on_base("", f"SELECT row // {CAPACITY} AS shard, feature, count(*) AS nnz, round(sum(value::FLOAT::DOUBLE), 3) AS sum FROM codes GROUP BY 1, 2"),
        "raw_roundtrip": f"SELECT vec_id // {CAPACITY} AS shard, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 3) AS sum FROM embeddings GROUP BY 1",
        "validation_metrics": on_base(
            recon("32") + """, held AS (SELECT row FROM act WHERE example_idx % 5 = 0), q AS (SELECT d, count(*) AS n, sum(x) AS s, sum(x * x) AS q, sum((x - y) * (x - y)) AS e FROM hat WHERE row IN (FROM held) GROUP BY d
            ), m AS (SELECT max(n) AS n_tokens, count(*) AS d_model, sum(e) AS e, sum(q) - sum(s * s / n) AS b FROM q), f AS (SELECT feature, count(c.value) AS nnz, coalesce(sum(c.value), 0) AS sum FROM features LEFT JOIN (SELECT * FROM codes WHERE row IN (FROM held)) c USING (feature) GROUP BY feature
            ), ev AS (SELECT sum(nnz) AS l0, sum(sum) AS l1, count_if(nnz = 0) AS n_dead, count_if(nnz / n_tokens::DOUBLE < 1e-7) AS n_almost_dead, count_if(nnz / n_tokens::DOUBLE > 1e-2) AS n_dense FROM f, m)""",
            "SELECT n_tokens, round(e / b, 6) AS nmse, round(e / (n_tokens * d_model), 6) AS mse_per_dim, round(l0 / n_tokens, 6) AS l0, round(l1 / n_tokens, 6) AS l1, n_dead::BIGINT AS n_dead, n_almost_dead::BIGINT AS n_almost_dead, n_dense::BIGINT AS n_dense FROM m, ev",
        ),
        "validation_freqs": on_base(", held AS (SELECT row FROM act WHERE example_idx % 5 = 0)", "SELECT feature, round(count(c.value) / (SELECT count(*) FROM held)::DOUBLE, 6) AS freq, round(coalesce(avg(c.value), 0), 6) AS mean_value FROM features LEFT JOIN (SELECT * FROM codes WHERE row IN (FROM held)) c USING (feature) GROUP BY feature"),
        "audit_yields": on_base(
            TIES + """, o AS (SELECT 'nnz' AS ranking, feature, row_number() OVER (ORDER BY nnz DESC, feature) AS position FROM stats UNION ALL SELECT 'sum', feature, row_number() OVER (ORDER BY sum DESC, feature) FROM stats
            ), best AS (SELECT feature, max(round(ap, 9)) AS ap FROM tap WHERE feature IN (SELECT feature FROM o WHERE position <= 10) GROUP BY feature)""",
            "SELECT ranking, budget, round(count_if(position <= budget AND ap >= 0.2) / budget::DOUBLE, 6) AS yield FROM o LEFT JOIN best USING (feature) CROSS JOIN (SELECT unnest([3, 10, 30])::INTEGER AS budget) GROUP BY 1, 2",
        ),
        "concept_lookup": on_base(
            """, sh AS (SELECT example_idx, max(n) / sum(n)::DOUBLE AS share FROM (SELECT example_idx, label, count(*) AS n FROM act GROUP BY 1, 2) GROUP BY 1), px AS (SELECT h.* FROM h JOIN sh USING (example_idx) WHERE share >= 0.5
            ), cf AS (SELECT feature, class, tau, count_if(h > tau AND label = class) AS tp, count_if(h > tau AND label <> class) AS fp, count_if(h <= tau AND label = class) AS fn FROM px CROSS JOIN classes CROSS JOIN (SELECT unnest([0.0, 0.1, 0.3, 1.0])::DOUBLE AS tau) WHERE class > 0 GROUP BY 1, 2, 3
            ), f1s AS (SELECT class, feature, tau, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 9) AS f1 FROM cf QUALIFY row_number() OVER (PARTITION BY class, feature ORDER BY f1 DESC, tau) = 1
            ), ok AS (SELECT class, feature, tau, CASE WHEN sparsity < 0.6 THEN f1 ELSE -1 END AS f1 FROM f1s JOIN stats USING (feature))""",
            "SELECT class, row_number() OVER (PARTITION BY class ORDER BY ok.f1 DESC, feature)::INTEGER AS place, feature, round(tau, 6) AS tau, round(ok.f1, 6) AS f1 FROM ok QUALIFY place <= 3",
        ),
        "zipped_streams": "SELECT label AS told, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 6) AS total FROM embeddings GROUP BY 1",
        "checkpoint_files": f"""SELECT t.*, p.part, t.d_sae AS n_rows, round(t.d_sae::DOUBLE, 6) AS squares
            FROM (VALUES (0::INTEGER, 'Relu', 0::INTEGER, {DIMS}::BIGINT), (1, 'BatchTopK', 8, {FEATURES}), (1, 'TopK', 16, {FEATURES}), (3, 'TopK', 4, {FEATURES}), (5, 'Relu', 0, {FEATURES})) t(schema, activation, top_k, d_sae),
            (VALUES ('enc'), ('dec')) p(part)""",
        "strict_metrics": """SELECT s_suppkey, CASE WHEN reason IS NULL THEN s_suppkey % 50 + 1 ELSE 0 END AS n_tokens, CASE WHEN reason IS NULL THEN round((s_suppkey % 7)::DOUBLE / (s_suppkey % 5 + 1), 6) END AS nmse, reason
            FROM (SELECT s_suppkey, CASE s_suppkey % 9 WHEN 1 THEN 'n_elements is no whole number' WHEN 2 THEN 'n_elements is no whole number' WHEN 3 THEN 'n_elements is not n_tokens times d_model'
              WHEN 4 THEN 'sse_recon is negative' WHEN 5 THEN 'sse_recon is no number' WHEN 6 THEN 'normalized_mse is not sse_recon / sse_baseline' WHEN 7 THEN 'sse_baseline is missing' WHEN 8 THEN 'not a JSON object' END AS reason FROM supplier)""",
        "canonical_hashes": """SELECT c_custkey, sha256('(m={s3:key=s' || length(c_custkey::VARCHAR) || ':' || c_custkey || ',s4:name=s' || length(c_name) || ':' || c_name || '},a=[i:' || c_custkey || ',i:' || c_custkey % 3 || '],s='
            || CASE WHEN c_custkey % 4 = 0 THEN 's' || length(c_name) || ':' || c_name ELSE 'n' END || ')') AS sha256, true AS same FROM customer""",
        "signed_probe_metrics": on_base(""", side AS (SELECT vec_id AS row, label FROM embeddings WHERE vec_id // 4 % 5 = 0
            ), scores AS (
              SELECT c.k AS class, s.row, (s.label = c.k)::INTEGER AS y, CASE WHEN c.k % 2 = 0 THEN 1 ELSE -1 END * coalesce(round(o.value, 3), 0) AS v
              FROM (SELECT unnest(range(0, 10))::INTEGER AS k) c CROSS JOIN side s LEFT JOIN codes o ON o.row = s.row AND o.feature = c.k
            ), groups AS (SELECT class, v, count(*) AS n, sum(y) AS pos FROM scores GROUP BY 1, 2
            ), placed AS (SELECT *, coalesce(sum(n) OVER w, 0) AS t, coalesce(sum(pos) OVER w, 0) AS r0 FROM groups WINDOW w AS (PARTITION BY class ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            ), parts AS (
              SELECT class, sum(pos / n::DOUBLE * (r0 + 1 + CASE WHEN n > 1 THEN (j - 1) * (pos - 1) / (n - 1)::DOUBLE ELSE 0 END) / (t + j)) AS s FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM placed WHERE pos > 0) GROUP BY class
            ), sums AS (SELECT class, sum(pos) AS total, sum(CASE WHEN v + 0.5 - class / 20 > 0 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN v + 0.5 - class / 20 > 0 THEN n ELSE 0 END) AS said FROM groups GROUP BY class)
            """, """SELECT class, total::BIGINT AS n_positive, round(coalesce(s / total, 0), 6) AS ap, round(CASE WHEN said > 0 THEN tp / said ELSE 0 END, 6) AS precision, round(CASE WHEN total > 0 THEN tp / total ELSE 0 END, 6) AS recall,
              round(CASE WHEN said + total > 0 THEN 2 * tp / (said + total) ELSE 0 END, 6) AS f1 FROM sums LEFT JOIN parts USING (class)"""),
    }
