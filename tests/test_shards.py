"""Sinks of shards: written by several tasks, read again, and nothing left of a failed write."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.sources import shards, store


def codes(spark, n=1000, features=40):
    """Random codes of every third row or so, spread over many partitions."""
    return spark.range(n).select(F.col("id").alias("row"), F.explode(F.array(*(F.lit(i) for i in range(features)))).alias("feature")).where("xxhash64(row, feature) % 7 = 0 and row % 3 > 0").withColumn("value", (F.col("row") % 11 + F.col("feature") / 8).cast("double")).repartition(9)


def test_sparse_shards_read_as_written(spark, tmp_path):
    made, path = codes(spark), f"file://{tmp_path}/csr"
    shards.write_csr(made, path, n_rows=1037, n_features=40, capacity=100)
    names = sorted(os.listdir(tmp_path / "csr"))
    assert names == [*(f"codes{i:06d}.npz" for i in range(11)), "shards.json"]
    said = shards.shard_manifest(path)
    assert [s["n_rows"] for s in said["shards"]] == [100] * 10 + [37] and sum(s["nnz"] for s in said["shards"]) == made.count() and said["shards"][10]["nnz"] == 0
    for s in said["shards"]:
        content = (tmp_path / "csr" / s["name"]).read_bytes()
        assert len(content) == s["bytes"] and hashlib.sha256(content).hexdigest() == s["sha256"]
    want = sorted(map(tuple, made.collect()))
    assert sorted(map(tuple, shards.read_csr(spark, path).collect())) == want
    spark.dataSource.register(store.SparseShards)
    plain = spark.read.format("sparse_shards").option("paths", ",".join(str(tmp_path / "csr" / s["name"]) for s in said["shards"])).load()
    assert sorted((100 * r.shard + r.row, r.feature, r.value) for r in plain.collect()) == want
    with np.load(tmp_path / "csr" / "codes000003.npz") as found:  # as scipy's sparse files
        assert found["format"].item() == b"csr" and found["shape"].tolist() == [100, 40] and len(found["indptr"]) == 101 and (np.diff(found["indptr"]) >= 0).all()


def test_raw_shards_read_as_written(spark, tmp_path):
    path, dims = f"file://{tmp_path}/raw", 6
    acts = spark.range(505).select(F.col("id").alias("row"), F.array(*((F.col("id") * 10 + i).cast("float") for i in range(dims))).alias("act")).repartition(7)
    shards.write_raw(acts, path, 505, dims, 128)
    said = shards.shard_manifest(path)
    assert [s["bytes"] for s in said["shards"]] == [128 * dims * 4] * 3 + [121 * dims * 4]
    spark.dataSource.register(store.FloatShards)
    back = spark.read.format("float_shards").options(paths=",".join(str(tmp_path / "raw" / s["name"]) for s in said["shards"]), dims=dims).load()
    assert sorted((128 * r.shard + r.row, list(r.act)) for r in back.collect()) == sorted((r.row, list(r.act)) for r in acts.collect())


def test_batches_smaller_than_shards(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        shards.write_csr(codes(spark, 300), f"file://{tmp_path}/csr", 300, 40, 50)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, shards.read_csr(spark, f"file://{tmp_path}/csr").collect())) == sorted(map(tuple, codes(spark, 300).collect()))


@pytest.mark.parametrize("fault", ["outside", "twice", "feature"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, fault):
    rows = {"outside": (5000, 1, 1.0), "twice": (1, 2, 3.0), "feature": (9, 40, 1.0)}[fault]
    extra = spark.createDataFrame([rows, rows] if fault == "twice" else [rows], "row long, feature int, value double")
    with pytest.raises(Exception, match="outside|twice"):
        shards.write_csr(codes(spark).unionByName(extra), f"file://{tmp_path}/csr", 1000, 40, 100)
    assert not (tmp_path / "csr").exists() or os.listdir(tmp_path / "csr") == []


def test_raw_rows_may_not_be_missing(spark, tmp_path):
    acts = spark.range(100).where("id <> 57").select(F.col("id").alias("row"), F.array(F.lit(1.0).cast("float")).alias("act"))
    with pytest.raises(Exception, match="57"):
        shards.write_raw(acts, f"file://{tmp_path}/a", 100, 1, 20)
    with pytest.raises(Exception, match="numbers"):
        shards.write_raw(spark.range(100).select(F.col("id").alias("row"), F.array(F.lit(1.0), F.lit(2.0)).alias("act")), f"file://{tmp_path}/b", 100, 1, 20)
    shards.write_raw(acts.where("row < 40"), f"file://{tmp_path}/c", 40, 1, 20)
    with pytest.raises(Exception, match="already"):
        shards.write_raw(acts.where("row < 40"), f"file://{tmp_path}/c", 40, 1, 20)
