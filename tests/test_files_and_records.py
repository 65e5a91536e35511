"""Checkpoint files, strict records, canonical hashes, ordered streams and held-out probe metrics."""

import io
import json
import math
import os
import pickle
import sys
import types
import zipfile
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.functions import columns as C
from glimmer.operators import ordered, probe, stats
from glimmer.plans.artifacts import HEADERS
from glimmer.sources import checkpoints

rng = np.random.default_rng(1)


def arrays(d_model=6, d_sae=4):
    return {"W_enc": rng.random((d_model, d_sae)), "W_dec": rng.random((d_sae, d_model)), "b_enc": rng.random(d_sae), "b_dec": rng.random(d_model)}


def state_zip(found, extra=None):
    """What a framework's save() makes of an ordered dictionary of float tensors: a pickle and raw storages in a zip."""
    names = {"torch": types.ModuleType("torch"), "torch._utils": types.ModuleType("torch._utils")}

    class FloatStorage:
        pass

    def _rebuild_tensor_v2(*_):
        raise AssertionError

    FloatStorage.__module__, FloatStorage.__qualname__ = "torch", "FloatStorage"
    _rebuild_tensor_v2.__module__, _rebuild_tensor_v2.__qualname__ = "torch._utils", "_rebuild_tensor_v2"
    names["torch"].FloatStorage, names["torch._utils"]._rebuild_tensor_v2 = FloatStorage, _rebuild_tensor_v2

    class Storage:
        def __init__(self, key, n):
            self.key, self.n = key, n

    class Tensor:
        def __init__(self, storage, x):
            self.storage, self.x = storage, x

        def __reduce__(self):
            return _rebuild_tensor_v2, (self.storage, 0, self.x.shape, tuple(s // self.x.itemsize for s in self.x.strides), False, OrderedDict())

    class Pickler(pickle.Pickler):
        def persistent_id(self, x):
            return ("storage", FloatStorage, x.key, "cpu", x.n) if isinstance(x, Storage) else None

    out, content, state = io.BytesIO(), io.BytesIO(), OrderedDict()
    before = {n: sys.modules.get(n) for n in names}
    sys.modules.update(names)
    try:
        with zipfile.ZipFile(out, "w") as archive:
            for i, (name, x) in enumerate(found.items()):
                x = np.asarray(x, dtype="<f4")
                archive.writestr(f"archive/data/{i}", x.tobytes())
                state[name] = Tensor(Storage(str(i), x.size), x)
            Pickler(content, protocol=2).dump(state if extra is None else extra)
            archive.writestr("archive/data.pkl", content.getvalue())
    finally:
        for n, m in before.items():
            sys.modules.pop(n) if m is None else sys.modules.update({n: m})
    return out.getvalue()


def test_headers_of_all_schemas():
    head = {name: checkpoints.settled(h) for name, h in HEADERS.items()}
    assert [(h["schema"], h["activation"], h["top_k"]) for h in head.values()] == [(0, "Relu", None), (1, "BatchTopK", 8), (1, "TopK", 16), (3, "TopK", 4), (5, "Relu", None)]
    assert json.loads(head["3"]["settings"]) == {"activation": {"key": "x"}} and json.loads(head["none"]["settings"]) == {}
    for bad in ({"schema": 6, "cfg": {}}, {"schema": 5, "cfg": {"d_model": 1, "d_sae": 1, "activation": {"cls": "Tanh", "params": {}}}}, {"schema": 4, "cfg": {"d_model": 1, "activation": {"cls": "Relu", "params": {}}}}, {"schema": 2, "cfg": {"d_model": 1, "d_sae": 2, "activation": {"cls": "TopK", "params": {"kind": 1, "key": 2}}}}):
        with pytest.raises(ValueError):
            checkpoints.settled(bad)


def test_files_of_all_kinds_read_as_one_relation(spark, tmp_path):
    cfg = {"d_model": 6, "d_sae": 4, "reinit_blend": 0.8, "activation": {"cls": "TopK", "params": {"top_k": 2}}}
    made = {"a": arrays(), "b": arrays(), "c": arrays(6, 12)}
    files = {
        "a": checkpoints.checkpoint_bytes({"schema": 5, "cfg": cfg, "lib": "1"}, made["a"]),
        "b": json.dumps({"schema": 4, "cfg": cfg | {"seed": 9}}).encode() + b"\n" + state_zip(made["b"]),
        "c": checkpoints.checkpoint_bytes({"d_vit": 6, "exp_factor": 2, "ghost_grads": False}, made["c"]),
    }
    folder = f"file://{tmp_path}/saved"
    checkpoints.write_checkpoints(spark.createDataFrame([(f"{k}.pt", bytearray(v)) for k, v in files.items()], "name string, content binary").repartition(3), folder)
    assert sorted(n for n in os.listdir(tmp_path / "saved") if not n.endswith(".crc")) == ["a.pt", "b.pt", "c.pt"]
    rows = {(os.path.basename(r.path)[0], r.part, r.at): r for r in checkpoints.read_checkpoints(spark, folder).collect()}
    assert len(rows) == 3 * 2 + 2 * (4 + 4 + 12)
    for name, found in made.items():
        close = 1e-6 if name == "b" else 0
        for i in range(len(found["W_dec"])):
            assert np.allclose(rows[name, "dec", i]["values"], found["W_dec"][i], atol=close) and np.allclose(rows[name, "enc", i]["values"], found["W_enc"][:, i], atol=close)
        assert np.allclose(rows[name, "bias_enc", 0]["values"], found["b_enc"], atol=close) and np.allclose(rows[name, "bias_dec", 0]["values"], found["b_dec"], atol=close)
    assert rows["b", "dec", 0].top_k == 2 and json.loads(rows["b", "dec", 0].settings) == {"reinit_blend": 0.8} and rows["c", "dec", 0].d_sae == 12


def test_bad_checkpoint_files(spark, tmp_path):
    cfg = {"d_model": 6, "d_sae": 5, "activation": {"cls": "Relu", "params": {}}}
    bad = {"shape": checkpoints.checkpoint_bytes({"schema": 5, "cfg": cfg}, arrays()), "code": json.dumps({"schema": 5, "cfg": cfg}).encode() + b"\n" + state_zip({}, extra=[os.path.join]), "bare": b'{"schema": 5}', "torn": b'{"schema": 5}\nPK'}
    for name, content in bad.items():
        (tmp_path / name).write_bytes(content)
        with pytest.raises(Exception, match=name):
            checkpoints.read_checkpoints(spark, f"file://{tmp_path}/{name}").collect()


GOOD = {"n_tokens": 3, "d_model": 4, "n_elements": 12, "sse_recon": 6, "sse_baseline": 8.0, "mse_per_dim": 0.5, "mse_per_token": 2, "normalized_mse": 0.75, "baseline_mse_per_dim": 8 / 12, "baseline_mse_per_token": 8 / 3}
BAD = {
    "n_tokens is missing": {"n_tokens": None}, "n_tokens is no whole number": {"n_tokens": True}, "d_model is no whole number": {"d_model": 4.0}, "sse_recon is no number": {"sse_recon": False}, "mse_per_dim is no number": {"mse_per_dim": "0.5"},
    "n_tokens is not positive": {"n_tokens": 0}, "n_elements is not n_tokens times d_model": {"n_elements": 13}, "sse_recon is negative": {"sse_recon": -1.0}, "sse_baseline is not positive": {"sse_baseline": 0},
    "normalized_mse is not sse_recon / sse_baseline": {"normalized_mse": 0.75001}, "mse_per_token is not sse_recon / n_tokens": {"mse_per_token": 3},
}


def test_strict_records(spark):
    rows = [(None, json.dumps(GOOD)), *((why, json.dumps(GOOD | change)) for why, change in BAD.items()), ("n_tokens is missing", "{}"), ("not a JSON object", "[1]"), ("not a JSON object", "{"), ("not a JSON object", None), ("not a JSON object", "")]
    frame = spark.createDataFrame(rows, "want string, text string")
    found = stats.strict_metrics(frame, "text").collect()
    assert [r.reason for r in found] == [r.want for r in found] == [w for w, _ in rows]
    assert found[0].n_tokens == 3 and found[0].sse_recon == 6.0 and math.isclose(found[0].baseline_mse_per_token, 8 / 3)
    assert stats.checked_metrics(frame.where("want is null"), "text").count() == 1
    with pytest.raises(Exception, match="n_tokens is missing"):
        stats.checked_metrics(frame.limit(2), "text").collect()


def test_canonical_values(spark):
    a = spark.sql("select map('x', array(1.0D, double('nan')), 'y', null) m, named_struct('p', 1, 'q', map(named_struct('k', 1), 'v', named_struct('k', 0), 'w')) s, array(3, 1, 3) l, -0.0D z, 'a,b' t, binary('x') b")
    b = spark.sql("select map('y', null, 'x', array(1.0D, double('nan'))) m, named_struct('p', 1, 'q', map(named_struct('k', 0), 'w', named_struct('k', 1), 'v')) s, array(1, 3) l, 0.0D z, 'a,b' t, binary('x') b")
    value = lambda df, c, **more: df.select(C.canonical(F.col(c), df.schema[c].dataType, **more).alias("v")).first().v
    for c in ("m", "s", "z", "t", "b"):
        assert value(a, c) == value(b, c)
    assert value(a, "l") != value(b, "l") and value(a, "l", unordered=True) == value(b, "l", unordered=True)
    plain = spark.sql("select 1 i, true t, '1' s, null n, array('a', 'b') x, array('a,s1:b') y, 1.0D d")
    assert len({value(plain, c) for c in plain.columns}) == 7
    hashes = [df.select(C.canonical_hash(df, ["m", "s", "z"]).alias("h")).first().h for df in (a, b)]
    assert hashes[0] == hashes[1] and len(hashes[0]) == 64


def test_streams_zip_by_position(spark, monkeypatch):
    n = 400
    a = spark.range(n).select(F.expr("id div 4").alias("e"), (F.col("id") % 4).alias("t"), F.col("id").alias("x")).repartition(5)
    b = spark.range(n).select(F.expr("id div 4").alias("e"), (F.col("id") % 4).alias("t"), (F.col("id") * 2).alias("y")).repartition(3)
    plans, merge = [], ordered.merged

    def watched(*given):
        found = merge(*given)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(ordered, "merged", watched)
    assert sorted((r.x, r.y) for r in ordered.zipped(a, b, ["e", "t"]).collect()) == [(i, 2 * i) for i in range(n)]
    assert "SortMergeJoin" in plans[0] and "Exchange" not in plans[0]
    for wrong, match in ((b.where("y <> 46"), "5/3"), (b.unionByName(b.where("y = 46")), "5/3"), (b.withColumn("t", F.col("t") + F.when(F.col("e") == 99, 1).otherwise(0)), "99/")):
        with pytest.raises(Exception, match=f"streams differ at {match}"):
            ordered.zipped(a, wrong, ["e", "t"])
    assert not [t for t in spark.catalog.listTables() if "glimmer_ordered" in t.name]


def test_running_sums_of_one_large_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4900, "a").otherwise("b").alias("g"), F.col("id").alias("v"), (F.col("id") % 7).alias("n"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen, keep = [], ordered.kept
    try:
        ordered.kept = lambda df: seen.append(keep(df)) or seen[-1]
        found = ordered.running(rows.repartition(4), ["g"], [F.desc("v")], {"s": F.col("n"), "k": F.lit(1)}).collect()
    finally:
        ordered.kept = keep
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert seen[-1].where("g = 'a'").select("__range").distinct().count() > 2  # one group, several tasks
    for g, low, high in (("a", 0, 4900), ("b", 4900, 5000)):
        total = 0
        for k, r in enumerate(sorted((r for r in found if r.g == g), key=lambda r: -r.v)):
            assert (r.v, r.s, r.k) == (high - 1 - k, total, k)
            total += r.n
        assert k == high - low - 1


def plain_metrics(scores, y):
    """Mean average precision over the orders of ties, precision, recall and F1 at a score over zero."""
    total, ap, above, hits = y.sum(), 0.0, 0, 0
    for s in sorted(set(scores.tolist()), reverse=True):
        mine = scores == s
        n, pos = mine.sum(), y[mine].sum()
        for j in range(1, n + 1):
            ap += pos / n * (hits + 1 + ((j - 1) * (pos - 1) / (n - 1) if n > 1 else 0)) / (above + j)
        above, hits = above + n, hits + pos
    said = scores > 0
    tp = y[said].sum()
    return total, ap / total if total else 0.0, tp / said.sum() if said.sum() else 0.0, tp / total if total else 0.0, 2 * tp / (said.sum() + total) if said.sum() + total else 0.0


def test_held_out_metrics_of_signed_scores(spark):
    n, classes = 150, 5
    x = np.round(rng.random((n, classes)) * (rng.random((n, classes)) < 0.4), 1)
    y = rng.integers(0, 4, n)  # class 4 has no rows
    w, b = [1.5, -2.0, 0.0, -0.5, 1.0], [-0.4, 0.3, 0.1, 0.0, -0.2]
    codes = spark.createDataFrame([(i, j, float(x[i, j])) for i, j in zip(*(v.tolist() for v in np.nonzero(x)), strict=True)], "row long, feature int, value double")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "row long, class int")
    best = spark.createDataFrame([(c, c, b[c], w[c]) for c in range(classes)], "class int, feature int, b double, w double")
    found = {r["class"]: r for r in probe.held_out_metrics(codes, labels, best, n).collect()}
    for c in range(classes):
        want = plain_metrics(w[c] * x[:, c] + b[c], (y == c).astype(int))
        assert np.allclose([found[c].n_positive, found[c].ap, found[c].precision, found[c].recall, found[c].f1], want, atol=1e-9)


def test_a_score_that_equals_the_cut_is_no_hit(spark):
    codes = spark.createDataFrame([(0, 7, 0.15), (1, 7, 0.149), (2, 7, 0.2)], "row long, feature int, value double")
    labels = spark.createDataFrame([(i, 7) for i in range(4)], "row long, class int")
    best = spark.createDataFrame([(7, 7, 0.5, 7 / 20, -1.0)], "class int, feature int, b double, cut double, w double")
    found = probe.held_out_metrics(codes, labels, best, 4).first()
    assert (found.n_positive, found.precision, found.recall) == (4, 1.0, 0.5)  # rows 1 and 3; 0 is at the cut, 2 below


def test_signed_probe_metrics_of_ten_times_the_table_equal_sql(spark):
    import duckdb
    from conftest import rows
    from glimmer.plans.artifacts import oracle_sql
    from glimmer.plans.evaluation import QUERIES

    folder = "/root/testdata/sf0.01"  # holds a score at a cut
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert rows(QUERIES["signed_probe_metrics"](spark, folder)) == rows(con.sql(oracle_sql()["signed_probe_metrics"]).df())


def test_probe_sides_are_checked(spark):
    codes = spark.createDataFrame([(0, 1, 1.0), (3, 2, 2.0)], "row long, feature int, value double")
    labels = spark.createDataFrame([(i, i % 3) for i in range(4)], "row long, label int")
    assert probe.checked_side(codes, labels, 4, 3) == 3 and probe.checked_side(codes, labels, 4, 3, 5) == 5
    shifted, twice = labels.withColumn("row", F.col("row") + 1), labels.withColumn("row", F.least("row", F.lit(2)))
    for c, y, n, f, k, match in ((codes, labels.limit(3), 4, 3, None, "labels"), (codes, shifted, 4, 3, None, "labels"), (codes, twice, 4, 3, None, "labels"), (codes, labels, 4, 2, None, "feature"), (codes.withColumn("row", F.col("row") + 1), labels, 4, 3, None, "codes reach row 4"), (codes, labels, 4, 3, 2, "class 2"), (codes, labels.withColumn("label", F.lit(None).cast("int")), 4, 3, None, "missing")):
        with pytest.raises(ValueError, match=match):
            probe.checked_side(c, y, n, f, k)


def plain_baselines(parts, start, every):
    """Each family over the batches in numpy: reconstructions of all vectors."""
    centres, counts = start.copy(), np.zeros(len(start))
    for x in parts:
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(len(centres)):
            mine = x[near == c]
            if len(mine):
                counts[c] += len(mine)
                centres[c] += (mine.sum(axis=0) - len(mine) * centres[c]) / counts[c]
    seen = np.concatenate(parts)
    mean = seen.mean(axis=0)
    _, _, v = np.linalg.svd(seen - mean, full_matrices=False)
    return {"kmeans": centres[((every[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)], "pca": (every - mean) @ v[:8].T @ v[:8] + mean}


def test_baselines_resume_and_equal_numpy(spark, tmp_path):
    from glimmer.operators import estimators
    from glimmer.plans import baselines

    x = rng.normal(size=(300, 12)) + 3 * (np.arange(300) % 8)[:, None] * np.eye(12)[np.arange(300) % 12]
    acts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, act array<double>").repartition(4)
    path, start = baselines.shuffled_batches(acts, 5, 3), x[:8]
    parts = [np.array([r.act for r in spark.read.parquet(path).where(F.col("batch") == b).collect()]) for b in range(3)]
    assert sum(map(len, parts)) == 300 and min(map(len, parts)) > 50
    want = plain_baselines(parts, start.copy(), x)
    for name in baselines.FAMILIES:
        whole = baselines.trained(name, acts, path, 3, start, f"file://{tmp_path}/whole")
        baselines.trained(name, acts, path, 3, start, f"file://{tmp_path}/torn", until=2)  # and stops here
        again = baselines.trained(name, acts, path, 3, start, f"file://{tmp_path}/torn")
        a, b = ({r.row: r.x_hat for r in baselines.family(name).rebuilt(m, acts).collect()} for m in (whole, again))
        assert all(np.allclose(a[i], b[i], atol=1e-8) for i in range(300))
        if name in want:
            assert all(np.allclose(a[i], want[name][i], atol=1e-6) for i in range(300))
        found = baselines.measured(name, whole, acts).first()
        assert 0 < found.nmse < 1 and found.l0 == (1 if name == "kmeans" else 8)
        assert len(baselines.Run(name, f"file://{tmp_path}/whole").states()) == 2
    with pytest.raises(ValueError, match="no family"):
        baselines.family("forest")
    scores = {r.row: r.scores for r in estimators.KMeans(start).transform(acts).collect()}
    assert all(np.allclose(scores[i], -np.sqrt(((x[i] - start) ** 2).sum(axis=1)), atol=1e-6) for i in range(300))


def test_probe_sums_by_slabs_of_classes(spark, monkeypatch):
    monkeypatch.setattr(probe, "SLAB_BYTES", 8 * len(probe.SUMS) * 7 * 2)  # two classes a slab
    monkeypatch.setattr(probe, "BLOCK", 3)
    n, k, f = 120, 5, 7
    x = np.round(rng.normal(size=(n, f)) * (rng.random((n, f)) < 0.4), 2)
    x[:, 6] = 0  # a feature without codes
    y = rng.integers(0, k, n)
    b, w = rng.normal(size=(f, k)), rng.normal(size=(f, k))
    codes = spark.createDataFrame([(i, j, float(x[i, j])) for i, j in zip(*(v.tolist() for v in np.nonzero(x)), strict=True)], "row long, feature int, value double").repartition(4)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "row long, class int")
    params = spark.createDataFrame([(i, j, float(b[i, j]), float(w[i, j]), 1e-3) for i in range(f) for j in range(k)], "feature int, class int, b double, w double, damping double")
    totals = spark.createDataFrame([(j, int((y == j).sum())) for j in range(k)], "class int, total long")
    found = {(r.feature, r["class"]): r for r in probe.probe_stats(codes, labels, params, probe.priors(totals, n), n).collect()}
    assert len(found) == f * k and found[6, 0].nnz is None
    for (i, j), r in found.items():
        z = b[i, j] + w[i, j] * x[:, i]
        mu, own = 1 / (1 + np.exp(-z)), (y == j).astype(float)
        p = own.mean()
        s = mu * (1 - mu)
        want = (mu.mean() - p + 1e-8 * (b[i, j] - np.log(p / (1 - p))), ((mu - own) * x[:, i]).mean() + 1e-8 * w[i, j], s.mean() + 1e-8, (s * x[:, i]).mean(), (s * x[:, i] ** 2).mean() + 1e-8, (np.logaddexp(0, z) - own * z).mean())
        assert np.allclose([r.g0, r.g1, r.h0, r.h1, r.h2, r.loss], want, atol=1e-10)
    with pytest.raises(ValueError, match="lacks"):
        probe.probe_stats(codes, labels, params.where("feature > 0 or class > 0"), probe.priors(totals, n), n)


def test_decayed_average_equals_the_fold(spark):
    from glimmer.streaming import online

    values = rng.random(60).tolist()
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "at long, v double").repartition(5)
    held = 0.5
    for v in values:
        held = 0.9 * held + 0.1 * v
    assert math.isclose(online.decayed_average(frame, [F.col("at")], "v", 0.9, 0.5).first().average, held, rel_tol=1e-9)
    assert online.decayed_average(frame.where("at < 0"), [F.col("at")], "v", 0.9, 0.5).first().average == 0.5
