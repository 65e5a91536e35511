"""Shards of a fixed number of rows as sinks: compressed sparse rows (npz) and raw float32 matrices.

Both are Python data source writers. write_csr and write_raw deal rows to tasks by shard and sort them; a task carries a
shard from batch to batch until its rows end, and writes each under a temporary name. The commit, once all tasks are
done, gives the files their names and writes the manifest last, so a folder without one holds nothing that counts. Tasks
that fail or run twice leave temporary files only, which commit and abort take away.

Rows are numbered from 0; shard i holds rows i * capacity up to the next shard's. A sparse row without codes is an empty
row of its shard. Values are float32, as the readers expect. A row that is given twice, or lies outside the rows of the
store, is an error, and so is a raw row that is missing or of another width.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST = "shards.json"
TEMPORARY = "_temporary"


def store_of(path: str) -> tuple:
    """(pyarrow's file system, the path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """The shards that a task has written: each a row of the manifest and its temporary name."""

    shards: list[tuple[dict, str]]


class Digesting(io.RawIOBase):
    """A stream that counts and hashes what passes."""

    def __init__(self, out) -> None:
        self.out, self.sha, self.size = out, hashlib.sha256(), 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(memoryview(data).cast("B"))
        return len(data)


class ShardWriter(DataSourceArrowWriter):
    """What both kinds share; a kind says how a shard's rows become bytes."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.capacity, self.rows, self.width = options["path"], int(options["capacity"]), int(options["rows"]), int(options["width"])
        if self.capacity < 1:
            raise ValueError("a shard holds at least one row")
        store, top = store_of(self.path)
        from pyarrow import fs

        if store.get_file_info(f"{top}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} holds shards already")

    def span(self, shard: int) -> tuple[int, int]:
        return shard * self.capacity, min(self.rows, (shard + 1) * self.capacity)

    def runs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        """(shard, rows) in order; a shard may come in several parts."""
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            if rows.min() < 0 or rows.max() >= self.rows:
                raise ValueError(f"a row lies outside the {self.rows} rows of the store")
            shards = rows // self.capacity
            edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for a, b in zip(edges, edges[1:], strict=False):
                yield int(shards[a]), batch.slice(a, b - a)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, top = store_of(self.path)
        store.create_dir(f"{top}/{TEMPORARY}")
        done, now, parts = [], None, []
        for shard, part in self.runs(iterator):
            if shard != now and parts:
                done.append(self.flush(store, top, now, parts))
                parts = []
            now = shard
            parts.append(part)
        if parts:
            done.append(self.flush(store, top, now, parts))
        return Written(done)

    def flush(self, store, top: str, shard: int, parts: list[pa.RecordBatch]) -> tuple[dict, str]:
        hidden = f"{TEMPORARY}/{shard}-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{top}/{hidden}", compression=None) as stream:
            out = Digesting(stream)
            more = self.put(out, shard, parts)
        a, b = self.span(shard)
        return {"name": f"{self.kind}{shard:06d}.{self.suffix}", "shard": shard, "first_row": a, "n_rows": b - a, "bytes": out.size, "sha256": out.sha.hexdigest(), **more}, hidden

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, top = store_of(self.path)
        found = sorted(((row, hidden) for m in messages if m is not None for row, hidden in m.shards), key=lambda x: x[0]["shard"])
        shards = [row["shard"] for row, _ in found]
        if shards != list(range(-(-self.rows // self.capacity))):
            self.abort(messages)
            raise ValueError("a shard is missing, or was dealt to two tasks")
        for row, hidden in found:
            store.move(f"{top}/{hidden}", f"{top}/{row['name']}")
        self.clear(store, top)
        with store.open_output_stream(f"{top}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"kind": self.kind, "capacity": self.capacity, "rows": self.rows, "width": self.width, "shards": [row for row, _ in found]}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clear(*store_of(self.path))

    def clear(self, store, top: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{top}/{TEMPORARY}").type != fs.FileType.NotFound:
            store.delete_dir(f"{top}/{TEMPORARY}")


class CsrWriter(ShardWriter):
    """(row, feature, value); a null feature only says that its shard exists."""

    kind, suffix = "codes", "npz"

    def put(self, out: Digesting, shard: int, parts: list[pa.RecordBatch]) -> dict:
        rows, features, values = (np.concatenate([p.column(i).drop_null().to_numpy(zero_copy_only=False) for p in (p.filter(p.column(1).is_valid()) for p in parts)]) for i in range(3))
        if len(features) and (features.min() < 0 or features.max() >= self.width):
            raise ValueError(f"a feature lies outside the {self.width} of the store")
        if ((rows[1:] == rows[:-1]) & (features[1:] == features[:-1])).any():
            raise ValueError("a feature of a row is given twice")
        a, b = self.span(shard)
        ends = np.searchsorted(rows, np.arange(a, b + 1)).astype(np.int64)
        np.savez(out, data=values.astype(np.float32), indices=features.astype(np.int32), indptr=ends, shape=np.array([b - a, self.width], dtype=np.int64), format=np.array(b"csr"))
        return {"nnz": len(values)}


class RawWriter(ShardWriter):
    """(row, act): float32 in order of rows, nothing else."""

    kind, suffix = "acts", "bin"

    def put(self, out: Digesting, shard: int, parts: list[pa.RecordBatch]) -> dict:
        a, b = self.span(shard)
        at = a
        for part in parts:
            rows = part.column(0).to_numpy(zero_copy_only=False)
            if (rows != at + np.arange(len(rows))).any():
                raise ValueError(f"row {at + int((rows != at + np.arange(len(rows))).argmax())} is missing or given twice")
            acts = part.column(1)
            flat = acts.flatten().to_numpy(zero_copy_only=False)
            if acts.null_count or len(flat) != self.width * len(rows) or not (np.diff(acts.offsets.to_numpy()) == self.width).all():
                raise ValueError(f"a vector has not {self.width} numbers")
            out.write(flat.astype("<f4").tobytes())
            at += len(rows)
        if at != b:
            raise ValueError(f"row {at} is missing")
        return {}


class CsrShards(DataSource):
    """Sparse shards of a folder: rows (row, feature, value) as read; writes by write_csr."""

    @classmethod
    def name(cls) -> str:
        return "csr_shards"

    def schema(self) -> str:
        return "row long, feature int, value double"

    def reader(self, schema: object) -> DataSourceReader:
        return CsrReader(self.options["path"])

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return CsrWriter(self.options)


class CsrReader(DataSourceReader):
    """One partition a shard of the manifest; digests are checked."""

    def __init__(self, path: str) -> None:
        store, top = store_of(path)
        with store.open_input_stream(f"{top}/{MANIFEST}") as file:
            self.path, self.shards = path, json.loads(file.read())["shards"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(self.shards))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        shard = self.shards[partition.value]
        store, top = store_of(self.path)
        with store.open_input_stream(f"{top}/{shard['name']}") as file:
            content = file.read()
        if hashlib.sha256(content).hexdigest() != shard["sha256"]:
            raise ValueError(f"{shard['name']} is not what was written")
        with np.load(io.BytesIO(content), allow_pickle=False) as found:
            data, indices, ends = found["data"], found["indices"], found["indptr"]
        rows = np.repeat(shard["first_row"] + np.arange(len(ends) - 1), np.diff(ends))
        for start in range(0, len(data), 1 << 18):
            own = slice(start, start + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(rows[own]), pa.array(indices[own]), pa.array(data[own].astype(np.float64))], names=["row", "feature", "value"])


class RawShards(DataSource):
    """The sink of write_raw; FloatShards reads the files."""

    @classmethod
    def name(cls) -> str:
        return "raw_shards"

    def schema(self) -> str:
        return "row long, act array<float>"

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return RawWriter(self.options)


def dealt(rows: DataFrame, capacity: int, *within: str) -> DataFrame:
    """A shard's rows in one task, in order."""
    shard = F.floor(F.col("row") / capacity)
    return rows.repartition(shard).sortWithinPartitions("row", *within)


def write_csr(codes: DataFrame, path: str, n_rows: int, n_features: int, capacity: int) -> None:
    """Codes (row, feature, value) as sparse shards of so many rows in a fresh folder."""
    spark = codes.sparkSession
    spark.dataSource.register(CsrShards)
    shards = spark.range(-(-n_rows // capacity)).select((F.col("id") * capacity).alias("row"), F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("value"))
    rows = codes.select(F.col("row").cast("long"), F.col("feature").cast("int"), F.col("value").cast("double")).where("feature is not null").unionByName(shards)
    dealt(rows, capacity, "feature").write.format("csr_shards").mode("append").options(path=path, capacity=capacity, rows=n_rows, width=n_features).save()


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """(row, feature, value) of what write_csr wrote."""
    spark.dataSource.register(CsrShards)
    return spark.read.format("csr_shards").option("path", path).load()


def write_raw(acts: DataFrame, path: str, n_rows: int, dims: int, capacity: int) -> None:
    """Vectors (row, act) as raw float32 shards of so many rows in a fresh folder."""
    acts.sparkSession.dataSource.register(RawShards)
    rows = acts.select(F.col("row").cast("long"), F.col("act").cast("array<float>"))
    dealt(rows, capacity).write.format("raw_shards").mode("append").options(path=path, capacity=capacity, rows=n_rows, width=dims).save()


def shard_manifest(path: str) -> dict:
    """The manifest of a folder of shards."""
    store, top = store_of(path)
    with store.open_input_stream(f"{top}/{MANIFEST}") as file:
        return json.loads(file.read())
