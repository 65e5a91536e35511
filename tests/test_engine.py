"""Operators on small inputs with values worked out by hand or by numpy: zeros, ties, empty inputs, single classes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.functions import columns as C
from glimmer.operators import encode, estimators, pixels, probe, ranking, relational, sparse, stats
from glimmer.plans import sweep
from glimmer.sources import store
from glimmer.streaming import online


def codes(spark, dense):
    """Codes of a dense matrix, and its features."""
    found = [(i, j, float(v)) for i, line in enumerate(dense) for j, v in enumerate(line) if v]
    return spark.createDataFrame(found, "row long, feature int, value double"), spark.createDataFrame([(j,) for j in range(len(dense[0]))], "feature int")


def as_dict(df, keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_feature_stats_with_a_dead_feature(spark):
    c, f = codes(spark, [[1, 0, -2], [3, 0, 4]])
    got = {r.feature: (r.nnz, r.sum, r.mean_value, r.sparsity) for r in sparse.feature_stats(c, f, 2).collect()}
    assert got == {0: (2, 4.0, 2.0, 1.0), 1: (0, 0.0, None, 0.0), 2: (1, 2.0, 2.0, 0.5)}


@pytest.mark.parametrize("k", [1, 2, 4, 6])
def test_topk_per_row_lets_zeros_compete(spark, k):
    dense = [[1, 2, 3, 0], [0, 0, 0, 0], [5, 4, 3, 2], [-5, -2, 0, -1], [-3, -6, -4, -7]]
    c, _ = codes(spark, dense)
    got = sparse.topk_per_row(c, spark.createDataFrame([(i,) for i in range(5)], "row long"), 4, k).orderBy("row", "rank").collect()
    for i, line in enumerate(dense):
        assert [r.value for r in got if r.row == i] == sorted(line, reverse=True)[: min(k, 4)]
        assert all(r.feature == 0 if r.value == 0 else line[r.feature] == r.value for r in got if r.row == i)


def test_topk_per_feature_fills_and_breaks_ties(spark):
    c, f = codes(spark, [[5, 0, -1], [5, 0, -2], [1, 0, 0]])
    got = as_dict(sparse.topk_per_feature(c, f, 3).select("feature", "rank", F.struct("row", "value").alias("v")), ["feature", "rank"], "v")
    assert [tuple(got[0, i]) for i in (1, 2, 3)] == [(0, 5.0), (1, 5.0), (2, 1.0)]
    assert [tuple(got[1, i]) for i in (1, 2, 3)] == [(0, 0.0)] * 3
    assert [tuple(got[2, i]) for i in (1, 2, 3)] == [(0, -1.0), (1, -2.0), (0, 0.0)]


def test_pooling_counts_absent_zeros(spark):
    c = spark.createDataFrame([(0, 0, 4.0), (0, 0, 2.0), (1, 0, -1.0), (2, 0, -3.0), (2, 0, -1.0)], "example_idx long, feature int, value double")
    assert as_dict(sparse.pool(c, 2, "max"), ["example_idx"], "value") == {(0,): 4.0, (2,): -1.0}
    assert as_dict(sparse.pool(c, 2, "mean"), ["example_idx"], "value") == {(0,): 3.0, (1,): -0.5, (2,): -2.0}
    with pytest.raises(ValueError):
        sparse.pool(c, 2, "median")


def tie_ap(scores, labels):
    """The mean over all orders of ties, by the definition of expected precision at each place."""
    order = sorted(set(scores), reverse=True)
    total, seen, before, out = sum(labels), 0, 0, 0.0
    for value in order:
        group = [y for s, y in zip(scores, labels, strict=True) if s == value]
        n, r = len(group), sum(group)
        for j in range(n):
            if r:
                out += r / n * (before + 1 + (j * (r - 1) / (n - 1) if n > 1 else 0)) / (seen + j + 1)
        seen, before = seen + n, before + r
    return out / total if total else 0.0


@pytest.mark.parametrize("scores, labels", [([0.9, 0.8, 0.1, 0], [1, 1, 0, 0]), ([1, 1], [1, 0]), ([1, 1, 1], [0, 1, 0]), ([0, 0, 0, 2], [1, 0, 1, 0]), ([0, 0], [0, 0]), ([3, 0, 3, 1], [1, 1, 1, 1]), ([-1, 0, 2], [1, 0, 1])])
def test_ranking_metrics(spark, scores, labels):
    c, f = codes(spark, [[s] for s in scores])
    positives = spark.createDataFrame([(i, 0) for i, y in enumerate(labels) if y], "row long, class int")
    totals = spark.createDataFrame([(0, sum(labels))], "class int, total long")
    groups = ranking.tie_groups(c, positives, f, len(scores), totals)
    assert ranking.tie_aware_ap(groups).first()["ap"] == pytest.approx(tie_ap(scores, labels))
    pairs = [(a > b) + 0.5 * (a == b) for a, y in zip(scores, labels, strict=True) if y for b, z in zip(scores, labels, strict=True) if not z]
    got = ranking.auroc(groups).first()["auroc"]
    assert got is None if not pairs else got == pytest.approx(sum(pairs) / len(pairs))


def test_average_precision_in_strict_order(spark):
    df = spark.createDataFrame([("a", s, y) for s, y in zip([0.9, 0.8, 0.7, 0.6, 0.5, 0.4], [1, 0, 1, 0, 1, 0], strict=True)] + [("b", 0.1, 0)], "g string, s double, y int")
    assert as_dict(ranking.average_precision(df, ["g"], [F.desc("s")]), ["g"], "ap") == {("a",): pytest.approx((1 + 2 / 3 + 3 / 5) / 3), ("b",): 0.0}


@pytest.mark.parametrize("q", [0.05, 0.5, 0.95, 1.0])
def test_dense_quantile_equals_numpy(spark, q):
    dense = np.maximum(np.random.default_rng(1).normal(size=(41, 5)), 0)
    dense[:, 2] = 0
    c, f = codes(spark, dense.tolist())
    got = as_dict(ranking.dense_quantile(c, f, 41, q), ["feature"], "cut")
    assert [got[j,] for j in range(5)] == pytest.approx(np.quantile(dense, q, axis=0).tolist())


def test_entropy_examples(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (1,), (1,), (1,)], "k int")
    r = stats.key_entropy(df, "k", 3).first()
    h = -(math.log(1 / 3) / 3 + 2 * math.log(2 / 3) / 3)
    assert (r.entropy, r.normalised, r.coverage) == pytest.approx((h, h / math.log(3), 2 / 3))
    assert stats.key_entropy(df, "k", 1).first().normalised == 0


def test_recon_metrics(spark):
    x = np.random.default_rng(2).normal(size=(7, 3))
    df = spark.createDataFrame([(a.tolist(), (a * 0.5).tolist()) for a in x], "x array<double>, x_hat array<double>")
    r = stats.recon_metrics(df).first()
    assert (r.n_tokens, r.d_model) == (7, 3)
    assert r.nmse == pytest.approx((x**2 / 4).sum() / ((x - x.mean(axis=0)) ** 2).sum())
    assert stats.recon_metrics(df.limit(1)).first().nmse is None


@pytest.mark.parametrize("mask, size, background, expected", [
    ([[0, 0, 1, 1], [0, 0, 1, 1], [2, 2, 3, 3], [2, 2, 3, 3]], 2, None, [0, 1, 2, 3]),
    ([[0, 0, 1, 1], [0, 2, 1, 1], [0, 0, 3, 3], [0, 0, 3, 3]], 2, 0, [2, 1, 0, 3]),
    ([[0, 0, 0, 1], [0, 0, 1, 1], [0, 2, 2, 2], [2, 2, 2, 2]], 2, None, [0, 1, 2, 2]),
    ([[0, 0], [0, 0], [1, 1], [1, 1]], 2, None, [0, 1]),
])
def test_patch_labels(spark, mask, size, background, expected):
    px = pixels.pixels(spark.createDataFrame([(0, mask)], "example_idx long, mask array<array<int>>"))
    got = as_dict(pixels.patch_labels(px, size, len(mask[0]) // size, background), ["token_idx"], "label")
    assert [got[i,] for i in range(len(expected))] == expected


def test_encode_and_decode_against_numpy(spark):
    x = np.random.default_rng(3).normal(size=(20, 6)).astype(np.float32)
    acts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, act array<float>").repartition(3)
    w = encode.datapoint_weights(acts, 4)
    d = x[:4].astype(np.float64) - x.astype(np.float64).mean(axis=0)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    assert np.allclose(w.dec, d, atol=1e-6)
    h = x @ d.T
    top = encode.dense_codes(acts, w, "topk", k=2)
    got = {(r.row, r.feature): r.value for r in top.collect()}
    assert set(got) == {(i, j) for i in range(20) for j in np.argsort(-h[i], kind="stable")[:2]}
    back = as_dict(encode.decode_prefixes(top, w, [2, 4]), ["row", "prefix"], "x_hat")
    kept = np.zeros_like(h)
    for (i, j), v in got.items():
        kept[i, j] = v
    assert np.allclose(back[5, 4], kept[5] @ d) and np.allclose(back[5, 2], kept[5, :2] @ d[:2])
    with pytest.raises(ValueError):
        encode.decode_prefixes(top, w, [4, 2])
    relu = encode.dense_codes(acts, w)
    made = as_dict(encode.edited(acts, relu, w, 1, 2.0), ["row"], "act")
    assert np.allclose(made[7,], x[7] + (2.0 - max(h[7, 1], 0)) * d[1], atol=1e-6)
    assert sum(1 for _ in encode.batch_topk(encode.dense_codes(acts, w, "all"), 1, 10).collect()) == 20
    assert encode.sampled_prefixes(50, 5, 1)[-1] == 50


def test_probes_reach_the_optimum(spark, tmp_path):
    random = np.random.default_rng(5)
    dense = np.where(random.random((300, 3)) < 0.4, random.exponential(size=(300, 3)), 0)
    dense[:, 2] = 0
    y = (random.random(300) < 1 / (1 + np.exp(1.5 - 1.2 * dense[:, 0]))).astype(int)
    c, f = codes(spark, dense.tolist())
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "row long, class int")
    totals = labels.groupBy("class").agg(F.count("*").alias("total"))
    base = probe.priors(totals, 300)
    got = as_dict(probe.fit_probes(c, labels, f, base, sparse.rms_scale(c, f), 300, 8, f"file://{tmp_path}").select("feature", "class", F.struct("b", "w", "loss").alias("p")), ["feature", "class"], "p")
    for j in (0, 1):
        b, w = 0.0, 0.0
        for _ in range(100):
            mu = 1 / (1 + np.exp(-(b + w * dense[:, j])))
            g, s = np.array([(mu - y).mean(), ((mu - y) * dense[:, j]).mean()]), mu * (1 - mu)
            hess = np.array([[s.mean(), (s * dense[:, j]).mean()], [(s * dense[:, j]).mean(), (s * dense[:, j] ** 2).mean()]])
            b, w = np.array([b, w]) - np.linalg.solve(hess + 1e-9 * np.eye(2), g)
        assert (got[j, 1].b, got[j, 1].w) == pytest.approx((b, w), abs=1e-3)
    assert got[2, 1].w == 0
    params = spark.createDataFrame([(k[0], k[1], p.b, p.w) for k, p in got.items()], "feature int, class int, b double, w double")
    table = as_dict(probe.probe_confusion(c, labels, params, base, 300, 0.5).select("feature", "class", F.struct("tp", "fp", "tn", "fn").alias("t")), ["feature", "class"], "t")
    says = 1 / (1 + np.exp(-(got[0, 1].b + got[0, 1].w * dense[:, 0]))) > 0.5
    assert tuple(table[0, 1]) == ((says & (y == 1)).sum(), (says & (y == 0)).sum(), (~says & (y == 0)).sum(), (~says & (y == 1)).sum())


def test_estimators(spark):
    random = np.random.default_rng(6)
    means = np.array([[-5, -5, 0], [0, 5, 5], [6, -1, -4]], dtype=float)
    x = np.concatenate([m + 0.02 * random.normal(size=(32, 3)) for m in means])
    acts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, act array<double>").repartition(4)
    fitted = estimators.KMeans(x[[0, 40, 80]])
    for _ in range(3):
        fitted = fitted.partial_fit(acts)
    assert np.abs(fitted.centres - means).max() < 0.2 and fitted.evaluate(acts).first().utilisation == 1
    lost = estimators.KMeans(np.array([[0.0, 0, 0], [900.0, 0, 0]])).partial_fit(acts)
    assert lost.counts[1] == 0 and np.abs(lost.centres[1]).max() < 10
    z = random.normal(size=(512, 2)) @ (np.diag([2.5, 1.0]) @ np.linalg.qr(random.normal(size=(6, 2)))[0].T)
    low = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "row long, act array<double>")
    parts = estimators.Pca().partial_fit(low.where("row < 100")).partial_fit(low.where("row >= 100"))
    assert np.allclose(parts.scatter / (parts.n - 1), np.cov(z.T))
    assert parts.components(2)[1].sum() == pytest.approx(1)
    nmf = estimators.SemiNmf(random.normal(size=(4, 6)))
    for _ in range(4):
        nmf = nmf.partial_fit(low)
    assert min(v for r in nmf.codes(low).collect() for v in r.z) >= 0
    assert stats.recon_metrics(nmf.transform(low).join(low.select("row", F.col("act").alias("x")), "row")).first().nmse < 0.3


def test_relational(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0, 1), ("a", 2.0, 5.0, 2), ("a", 3.0, 4.0, 3), ("a", 4.0, 6.0, 4), ("a", None, 0.0, 5)], "g string, x double, y double, id int")
    assert sorted(r.id for r in relational.pareto(df.where("x is not null"), ["g"], "x", "y").collect()) == [1, 2, 3]
    assert sorted(r.id for r in relational.pareto(df, ["g"], "x", "y", strict=True).collect()) == [1, 3]
    many = spark.createDataFrame([("a", float(i), 100.0 - i, i) for i in range(50)], "g string, x double, y double, id int")
    kept = sorted(r.id for r in relational.spaced_frontier(many, ["g"], "x", "y", 6).collect())
    assert len(kept) == 6 and kept[0] == 0 and kept[-1] == 49
    with pytest.raises(ValueError):
        relational.group_labels(df, "g", {"p": ["a"], "q": ["a"]})
    got = relational.group_labels(spark.createDataFrame([("x",), ("y",), ("z",)], "l string"), "l", {"n": ["y"], "m": ["x"]}).collect()
    assert {r.l: (r.group_id, r.in_task) for r in got} == {"x": (0, True), "y": (1, True), "z": (-1, False)}
    left = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(Exception, match="no match for image 2"):
        relational.checked_join(left, left.where("k = 1"), ["k"], "image").collect()
    assert relational.same_keys(left, left).count() == 0


def test_store(spark, tmp_path):
    layout = store.Layout(16, True, (0,), 128, 10, 256)
    assert (layout.examples_per_shard, layout.shards, layout.rows(), layout.rows("all")) == (15, 1, 160, 170)
    with pytest.raises(ValueError):
        store.Layout(300, False, (0, 1), 8, 1, 256).examples_per_shard
    small = store.Layout(2, False, (0,), 3, 5, 4)
    acts = spark.createDataFrame([(e, t, 0, [float(e), float(t), 0.0]) for e in range(5) for t in range(2)], "example_idx long, token_idx int, layer int, act array<float>")
    manifest = store.write_store(acts, small, f"file://{tmp_path}/store")
    assert sorted((r.shard_idx, r.n_examples) for r in manifest.collect()) == [(0, 2), (1, 2), (2, 1)]
    for i in range(2):
        np.arange(12, dtype="<f4").reshape(4, 3).tofile(tmp_path / f"acts{i}.bin")
    (tmp_path / "acts2.bin").touch()
    spark.dataSource.register(store.FloatShards)
    raw = spark.read.format("float_shards").option("paths", f"{tmp_path}/acts0.bin,{tmp_path}/acts1.bin").option("dims", "3").load()
    assert sorted((r.shard, r.row, tuple(r.act)) for r in raw.collect())[4] == (1, 0, (0.0, 1.0, 2.0))
    names = spark.createDataFrame([("acts0.bin",), ("acts2.bin",), ("acts9.bin",)], "name string")
    faults = store.check_manifest(names, store.listing(spark, f"file://{tmp_path}", "acts*.bin").select("name", "length"))
    assert {r.name: r.problem for r in faults.collect()} == {"acts1.bin": "not listed", "acts2.bin": "empty", "acts9.bin": "missing"}
    with pytest.raises(IndexError):
        store.lookup(acts, [-1], 10)
    lines = spark.createDataFrame([("a b 1",), ("",), ("c d",)], "value string")
    assert sorted((r.stem, r.label) for r in store.label_lines(lines).collect()) == [("a b", "1"), ("c", "d")]
    assert store.fake_labels(spark, 2, 4, 3, 1).where("label = 0").count() == 4  # background of both, and (3 + 0), (2 + 1) modulo 3
    images = spark.createDataFrame([("/d/cat/1.PNG",), ("/d/ant/2.jpg",), ("/d/ant/x.txt",)], "path string")
    assert {(r.label, r.target) for r in store.image_folder(images).collect()} == {("ant", 0), ("cat", 1)}


def test_columns(spark):
    row = spark.range(1).select(
        C.sigmoid(F.lit(800.0)).alias("a"), C.sigmoid(F.lit(-800.0)).alias("b"), C.softplus(F.lit(0.0)).alias("c"), C.safe_name(F.lit("a b/ü.txt")).alias("d"), C.hex_colour(F.lit("rgb(255, 0, 51)")).alias("e"),
        C.keyword(F.lit("Open mouthed wings"), "open-mouthed").alias("f"), C.human_bytes(F.lit(2.5e12)).alias("g"), C.normalised(F.array(F.lit(3.0), F.lit(4.0))).alias("h"), C.normalised(F.array(F.lit(0.0))).alias("i"), C.safe_ratio(F.lit(1.0), F.lit(0.0)).alias("j"),
        C.numeric_range(F.lit("3 - ?"))[0].alias("k"), C.numeric_range(F.lit("3 - ?"))[1].alias("l"), C.canonical_map(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))).alias("m"), C.mel_to_hz(C.hz_to_mel(F.lit(440.0))).alias("n"),
    ).first()
    assert row.a == 1 - 1e-12 and row.b == 1e-12 and row.c == pytest.approx(math.log(2)) and row.d == "a_b_ü.txt" and row.e == [1.0, 0.0, 0.2] and row.f
    assert row.g == "2.5 TB" and row.h == [0.6, 0.8] and row.i is None and row.j is None and row.k == 3.0 and row.l is None and row.m == '{"a":2,"b":1}' and row.n == pytest.approx(440)
    with pytest.raises(Exception, match="outside"):
        spark.range(1).select(C.mapped_range(F.lit(2.0), 0, 1, 0, 10)).collect()


def test_byte_sizes_of_large_keys(spark, tmp_path):
    """Halves that the JVM's pow misses by a bit, and sizes of more digits than a double is written with."""
    import duckdb
    from glimmer.plans.evaluation import QUERIES
    from glimmer.plans.evaluation_oracle import oracle_sql

    keys = [0, 1, 50, 999, 10443, 19650, 37369, 41151, 732717, 732718, 1999993, 9000000, 123456789]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").repartition(2).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = dict(con.sql(oracle_sql()["byte_sizes"]).fetchall())
    assert {r.s_suppkey: r["size"] for r in QUERIES["byte_sizes"](spark, str(tmp_path)).collect()} == want and len(want) == len(keys)


def test_patch_grids_take_the_nearest_shape(spark):
    """Against all factors; a key with two rows, and images without a patch. Its plan joins up no rows a factor."""
    from glimmer.operators import pixels

    images = [(i, i * 7 % 240 + 1, i % 7 + 1, i % 5 + 1) for i in range(300)] + [(5, 5 * 7 + 1, 6, 1), (900, 0, 1, 1), (901, None, 1, 1), (902, 1_000_003 * 2, 1, 1)]
    frame = spark.createDataFrame(images, "k int, n int, width int, height int")
    want = {}
    for k, n, width, height in images:
        for w in [d for d in range(1, (n or 0) + 1) if n % d == 0]:
            want[k] = min(want.get(k, (9e9,)), (abs(w / (n // w) - width / height), w, n // w))
    found = pixels.patch_grids(frame, "k")
    assert {r.k: (r.w, r.h) for r in found.collect()} == {k: v[1:] for k, v in want.items()}
    assert "Generate" not in found._jdf.queryExecution().toString()


def test_sweep(spark):
    made = sweep.expand({"a": [1, 2], "b": {"c": [3, 4], "d": 5}})
    assert made[1] == {"a": 1, "b": {"c": 4, "d": 5}} and len(made) == 4
    assert sweep.merged({"a": 1, "b": {"c": 2}}, {"b": {"c": 3}}, {"a": 9, "z": 1}) == ({"a": 9, "b": {"c": 3}}, ["unknown key z"])
    assert [c["seed"] for c in sweep.with_seeds([{"seed": 5}, {"seed": 5}])] == [5, 6]
    assert sweep.differing({"a": 1, "b": {"c": 2}}, {"a": 1, "b": {"c": 3}}) == {"b.c": 3}
    assert sweep.identity({"a": 1, "b": 2}) == sweep.identity({"b": 2, "a": 1})


def test_streams_reach_the_batch_result(spark, tmp_path):
    from conftest import DATA

    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(5).write.parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "2").parquet(f"{tmp_path}/in")
    run = online.running_stats(read, "event_type", "value").writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    run.awaitTermination(120)
    got = {r.event_type: (r.n, r.mean, r.variance) for r in online.finished(spark.table("sums"), "event_type").collect()}
    for r in online.finished(online.running_stats(events, "event_type", "value"), "event_type").collect():
        assert got[r.event_type] == pytest.approx((r.n, r.mean, r.variance))
    fold, result = online.each_batch(lambda held, batch: held + batch.count(), 0)
    read.writeStream.foreachBatch(fold).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start().awaitTermination(120)
    assert result() == events.count()
    seen = online.since_active(read.select(F.col("user_id").alias("feature"), F.col("event_id").alias("row")))
    run = seen.writeStream.outputMode("update").format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c3").start()
    run.awaitTermination(120)
    last = {r.feature: r.m for r in spark.table("seen").groupBy("feature").agg(F.max("last").alias("m")).collect()}
    assert last == {r.user_id: r.m for r in events.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    assert online.percentile_sgd([float(i % 100) for i in range(20000)], 90, 1.0, 20000) == pytest.approx(90, abs=5)


def test_readers(spark, tmp_path):
    from glimmer.sources import readers

    (tmp_path / "a.csv").write_text("Name,Size\nx,1\ny,?\nz\nw,4,5\n")
    assert [(r["name"], r["size"]) for r in readers.read_csv(spark, f"file://{tmp_path}/a.csv", "name string, size int").orderBy("name").collect()] == [("w", 4), ("x", 1), ("y", None), ("z", None)]
    for i in range(3):
        (tmp_path / f"{'keep' if i else 'skip'}{i}.json").write_text(f'{{"a": {{"b": {i}, "c": [1]}}}}')
    found = readers.read_results(spark, f"file://{tmp_path}/*.json", "a struct<b: int, c: array<int>>", "keep")
    flat = readers.flattened(found)
    assert flat.columns == ["a.b", "a.c", "file"] and sorted(r["a.b"] for r in flat.collect()) == [1, 2]
    assert readers.scalar_columns(flat).columns == ["a.b", "file"]
    with pytest.raises(ValueError, match="lacks y, z"):
        (tmp_path / "m.txt").write_text('{"x": 1}')
        readers.read_metadata(spark, f"file://{tmp_path}/m.txt", ("x", "y", "z"))
    with pytest.raises(ValueError, match="none of"):
        readers.resolve_columns(found, {"stem": ["stem", "name"]})
    work = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    assert [r.k for r in readers.pending(work, work.where("k = 2"), ["k"]).collect()] == [1]
    assert readers.write_once(work, f"file://{tmp_path}/o") and not readers.write_once(work, f"file://{tmp_path}/o")
    (tmp_path / "c.tsv").write_text("id\tname\n1\tcat\n")
    assert tuple(readers.read_classes(spark, f"file://{tmp_path}/c.tsv").first()) == (1, "cat")


def test_classifiers_rank_the_telling_feature_first(spark):
    from glimmer.operators import classify

    random = np.random.default_rng(8)
    rows = [(i, j, float(v)) for i in range(120) for j, v in enumerate(random.random(4) * [1, 1, 1, 0.1] + ([0, 0, 3 * (i % 2), 0])) if v > 0.05]
    codes = spark.createDataFrame(rows, "example_idx long, feature int, value double")
    labelled = spark.createDataFrame([(i, i % 2) for i in range(121)], "example_idx long, label int")
    data = classify.example_rows(codes, labelled)
    assert data.count() == 121 and list(data.where("example_idx = 120").first()["at"]) == []
    for model in (classify.l1_logistic(data, 4, 2, c=1.0), classify.tree(data, 4, 2)):
        assert classify.feature_ranking(model, 4, spark).where("place = 1").first().feature == 2


def test_tie_groups_of_billions_need_no_array(spark):
    """The group of absent scores of 3 * 10^9 rows enters by two harmonic numbers."""
    n = 3 * 10**9
    codes = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.4)], "row long, feature int, value double")
    positives = spark.createDataFrame([(1, 0)], "row long, class int")
    features = spark.createDataFrame([(0,)], "feature int")
    grouped = ranking.tie_groups(codes, positives, features, n, spark.createDataFrame([(0, 3)], "class int, total long"))
    r = ranking.tie_aware_ap(grouped).first()
    t, size, pos = 2, n - 2, 2
    slope = (pos - 1) / (size - 1)
    harmonic = (np.log(n) + np.euler_gamma + 1 / (2 * n)) - 1.5
    want = (1 + pos / size * ((1 + 1 - (t + 1) * slope) * harmonic + slope * size)) / 3
    assert r.ap == pytest.approx(want, rel=1e-9)
    assert ranking.auroc(grouped).first().auroc == pytest.approx((1 * (n - 0.0) + 2 * (size + 1) / 2 - 6) / (3 * (n - 3)), rel=1e-6)


def test_harmonic_numbers(spark):
    from glimmer.functions import columns

    got = {r.m: r.h for r in spark.range(0, 60).select(F.col("id").alias("m"), columns.harmonic(F.col("id")).alias("h")).collect()}
    assert all(got[m] == pytest.approx(sum(1 / j for j in range(1, m + 1)), abs=1e-10) for m in got)


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_quantiles_equal_numpy(spark, accuracy):
    chance = np.random.default_rng(3)
    values = {"a": chance.normal(size=3000), "b": chance.integers(0, 4, 2000).astype(float), "c": chance.random(7), "d": np.r_[np.zeros(1500), chance.random(500)]}
    rows = [(k, float(v)) for k, own in values.items() for v in own] + [("a", None)]
    got = ranking.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", [0.0, 0.05, 0.5, 0.951, 1.0], accuracy=accuracy).collect()
    for r in got:
        for i, q in enumerate([0.0, 0.05, 0.5, 0.951, 1.0]):
            assert r[f"q{i}"] == pytest.approx(np.quantile(values[r.g], q), abs=1e-12)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_quantiles_of_one_large_group(spark, threshold):
    """Rows stay where they are if groups can be sent to them; otherwise one group is read by several tasks."""
    context, store = spark._jsc.sc(), spark._jsc.sc().statusStore()
    none = spark._sc._gateway.new_array(spark._sc._jvm.double, 0)

    def read():
        """The most rows of an exchange that a task has read, by stage."""
        context.listenerBus().waitUntilEmpty()
        stages, found = store.stageList(None, False, False, none, None).iterator(), {}
        while stages.hasNext():
            s = stages.next()
            if s.shuffleReadRecords():
                tasks = store.taskList(s.stageId(), s.attemptId(), 1000)
                found[s.stageId()] = max(tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size()))
        return found

    n = 1_500_000
    df = spark.range(n).select(F.regexp_replace(F.col("id").cast("string"), r"\d+", "a").alias("g"), F.hash("id").cast("double").alias("v"))
    values, earlier, was = df.toPandas()["v"].to_numpy(), read(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = ranking.exact_quantiles(df, ["g"], "v", [0.05, 0.5]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert [found[0].q0, found[0].q1] == pytest.approx(np.quantile(values, [0.05, 0.5]).tolist(), abs=1e-6) and len(found) == 1
    assert max(v for k, v in read().items() if k not in earlier) < (n / 10 if threshold == "10m" else 0.6 * n)


def test_ranks_over_ranges(spark):
    from glimmer.operators import relational

    rows = [(i, i * 37 % 101) for i in range(400)]
    got = {r.i: r.place for r in relational.ranked(spark.createDataFrame(rows, "i int, v int").repartition(6), [F.desc("v"), F.col("i")]).collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}


def test_probes_meet_their_labels_once(spark, tmp_path):
    """However many passes: the codes are read once to be labelled and once more for their scales."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    c = spark.createDataFrame([(i, i % 3, float(i % 7 + 1)) for i in range(60)], "row long, feature int, value double").mapInArrow(counted, "row long, feature int, value double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "row long, class int")
    base = probe.priors(labels.groupBy("class").agg(F.count("*").alias("total")), 60)
    features = spark.range(3).select(F.col("id").cast("int").alias("feature"))
    assert probe.fit_probes(c, labels, features, base, sparse.rms_scale(c, features), 60, 3, f"file://{tmp_path}").count() == 6
    assert seen.value <= 2 * 60


def test_fitted_probes_stand_still(spark):
    """probe_report on the smallest table against a plain logistic regression of the chosen feature."""
    from conftest import DATA
    from glimmer.plans.evaluation import QUERIES, probe_side
    from glimmer.plans.relations import Relations

    r = Relations(spark, DATA)
    codes, labels, base, n = probe_side(r, test=False)
    rows, by_row = sorted(x.row for x in labels.collect()), {x.row: x["class"] for x in labels.collect()}
    place = {row: i for i, row in enumerate(rows)}
    x = np.zeros((32, n))
    for c in codes.collect():
        x[c.feature, place[c.row]] = c.value
    for found in QUERIES["probe_report"](spark, DATA).collect():
        y = np.array([by_row[row] == found["class"] for row in rows], dtype=float)
        losses = []
        for f in range(32):
            w = np.zeros(2)
            design = np.c_[np.ones(n), x[f]]
            for _ in range(60):
                p = 1 / (1 + np.exp(-design @ w))
                w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) / n + 1e-6 * np.eye(2), design.T @ (p - y) / n)
            z = design @ w
            losses.append(float(np.mean(np.logaddexp(0, z) - y * z)))
        assert found.loss == pytest.approx(min(losses), abs=2e-5) and losses[found.feature] == pytest.approx(min(losses), abs=2e-5)


def test_baseline_run_equals_numpy(spark):
    from conftest import DATA
    from glimmer.functions import columns
    from glimmer.operators import estimators
    from glimmer.plans.evaluation import QUERIES
    from glimmer.plans.relations import Relations

    r = Relations(spark, DATA)
    rows = r.acts.select("row", "act", F.conv(F.substring(columns.shuffle_key(5, F.col("row")), 1, 1), 16, 10).cast("int").alias("h")).collect()
    centres, counts = r.weights.dec[:8].astype(float).copy(), np.zeros(8)
    for batch in range(4):
        own = np.array([x.act for x in rows if x.h // 4 == batch], dtype=float)
        near = ((own[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(8):
            mine = own[near == c]
            if len(mine):
                counts[c] += len(mine)
                centres[c] += (mine.sum(axis=0) - len(mine) * centres[c]) / counts[c]
    every = np.array([x.act for x in rows], dtype=float)
    inertia = ((every[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()
    found = QUERIES["baseline_run"](spark, DATA).first()
    assert 0 < found.utilisation and found.inertia == pytest.approx(inertia, rel=0.05)
    assert isinstance(estimators.KMeans(r.weights.dec[:8]), estimators.KMeans)


def test_raw_labels(spark, tmp_path):
    from glimmer.sources import store

    parts = [np.arange(300, dtype=np.uint8), np.full(5, 255, dtype=np.uint8)]
    paths = []
    for i, part in enumerate(parts):
        paths.append(str(tmp_path / f"{i}.bin"))
        part.tofile(paths[-1])
    spark.dataSource.register(store.ByteShards)
    got = spark.read.format("byte_shards").option("paths", ",".join(paths)).load().orderBy("shard", "row").collect()
    assert [r.label for r in got] == [*parts[0].tolist(), *parts[1].tolist()] and got[-1].row == 4


def test_an_estimator_survives_a_restart(spark, tmp_path):
    from glimmer.streaming import online

    def fit(held, batch):
        return held + batch.count()

    folder = f"file://{tmp_path}/state"
    fold, state = online.each_batch(fit, 0, folder)
    for number in range(3):
        fold(spark.range(10 * (number + 1)), number)
    fold, again = online.each_batch(fit, 0, folder)
    fold(spark.range(999), 2)  # delivered twice
    fold(spark.range(5), 3)
    assert state() == 60 and again() == 65


def test_doubled_stems_are_an_error(spark):
    from glimmer.sources import store

    images = spark.createDataFrame([("/a/x.jpg",), ("/b/x.png",)], "path string")
    masks, table = spark.createDataFrame([("/m/x.png",)], "path string"), spark.createDataFrame([("x", "p")], "stem string, label string")
    with pytest.raises(Exception, match="holds a stem twice"):
        store.stem_join(images, masks, table, ["label"]).collect()


def test_npz_files(spark, tmp_path):
    from glimmer.sources import store

    dense = np.random.default_rng(8).random((6, 5)) * (np.random.default_rng(9).random((6, 5)) > 0.6)
    rows, features = dense.nonzero()
    ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=6))]
    np.savez(tmp_path / "codes.npz", data=dense[rows, features], indices=features, indptr=ends, shape=dense.shape)
    spark.dataSource.register(store.SparseShards)
    got = spark.read.format("sparse_shards").option("paths", str(tmp_path / "codes.npz")).load().collect()
    assert sorted((r.row, r.feature, r.value) for r in got) == sorted(zip(rows.tolist(), features.tolist(), dense[rows, features].tolist(), strict=True))
    np.savez(tmp_path / "probe.npz", w=dense, b=dense[0])
    back = {(r.name, r["at"]): r["values"] for r in store.read_matrices(spark, f"file://{tmp_path}/probe.npz", ["w", "b"]).collect()}
    assert back["b", 0] == dense[0].tolist() and all(back["w", i] == dense[i].tolist() for i in range(6))


def test_unknown_transforms_are_refused(spark):
    acts = spark.createDataFrame([(0, [1.0, 2.0])], "row long, act array<double>")
    with pytest.raises(ValueError, match="no transform"):
        encode.dense_codes(acts, encode.Weights(np.eye(2), np.eye(2), np.zeros(2), np.zeros(2)), "nothing")
