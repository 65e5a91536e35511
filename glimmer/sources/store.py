"""The activation store: vectors of examples, layers and tokens, in shards, with labels of tokens."""

from __future__ import annotations

import atexit
import hashlib
import io
import json
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glimmer.functions.columns import shuffle_key

if TYPE_CHECKING:
    from glimmer.operators.encode import Weights


_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names. Where that is unset, a local one, but only if all tasks
    run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        if key not in _LOCAL:
            _LOCAL[key] = tempfile.TemporaryDirectory(prefix="glimmer-engine-")
            atexit.register(_LOCAL[key].cleanup)
        folder = f"file://{_LOCAL[key].name}"
    path = f"{folder.rstrip('/')}/glimmer-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the scratch folder: computed once, whoever reads it, and not lost with an executor."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Layout:
    """content_tokens an example; special: whether each has one special token too, before the others; layers; dims;
    examples; and the most tokens of a shard, all layers counted."""

    content_tokens: int
    special: bool
    layers: tuple[int, ...]
    dims: int
    examples: int
    tokens_per_shard: int

    @property
    def tokens(self) -> int:
        return self.content_tokens + int(self.special)

    @property
    def examples_per_shard(self) -> int:
        n = self.tokens_per_shard // (self.tokens * len(self.layers))
        if n < 1:
            raise ValueError("a shard holds less than one example")
        return n

    @property
    def shards(self) -> int:
        return -(-self.examples // self.examples_per_shard)

    def rows(self, tokens: str = "content", layers: int = 1) -> int:
        """Vectors of a scan: "content", "special" or "all" tokens, of so many layers."""
        return self.examples * layers * {"content": self.content_tokens, "special": int(self.special), "all": self.tokens}[tokens]

    @property
    def identity(self) -> str:
        """Eight digits of the SHA-256 of the layout as sorted JSON."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:8]


def addresses(df: DataFrame, layout: Layout, index: str = "i", tokens: str = "content", layer_position: int = 0) -> DataFrame:
    """df with example_idx, token_idx, shard_idx, example_in_shard, token_in_shard and byte_offset of a row number.
    A special token has token_idx -1."""
    per = {"content": layout.content_tokens, "special": 1, "all": layout.tokens}[tokens]
    i, s = F.col(index).cast("long"), layout.examples_per_shard
    example = F.expr(f"`{index}` div {per}")
    token = i % per
    placed = {"content": token + int(layout.special), "special": F.lit(0).cast("long"), "all": token}[tokens]
    found = df.withColumn("example_idx", example).withColumn("token_in_shard", placed.cast("long"))
    found = found.withColumn("token_idx", F.col("token_in_shard") - int(layout.special)).withColumn("shard_idx", F.expr(f"example_idx div {s}")).withColumn("example_in_shard", F.col("example_idx") % s)
    offset = ((F.col("example_in_shard") * len(layout.layers) + layer_position) * layout.tokens + F.col("token_in_shard")) * layout.dims * 4
    return found.withColumn("byte_offset", offset)


def ordered_scan(acts: DataFrame, labels: DataFrame | None = None, layer: int | None = None, tokens: str = "all") -> DataFrame:
    """Vectors in (example_idx, token_idx) order, with token labels where there are; layer and kind of token by choice."""
    if layer is not None:
        acts = acts.where(F.col("layer") == layer)
    if tokens != "all":
        acts = acts.where(F.col("token_idx") >= 0 if tokens == "content" else F.col("token_idx") == -1)
    if labels is not None:
        acts = acts.join(labels, ["example_idx", "token_idx"], "left")
    return acts.orderBy("example_idx", "token_idx")


def shuffled_scan(acts: DataFrame, seed: int, keys: list[str], ignored_labels: list[int] = (), label: str = "label") -> DataFrame:
    """Every vector once, in an order fixed by the seed; rows with ignored labels are left out before vectors are read."""
    if ignored_labels:
        acts = acts.where(~F.col(label).isin(list(ignored_labels)) | F.col(label).isNull())
    return acts.withColumn("shuffle_key", shuffle_key(seed, *(F.col(k) for k in keys))).orderBy("shuffle_key", *keys)


def lookup(acts: DataFrame, rows: list[int], n_rows: int, row: str = "row") -> DataFrame:
    """The vectors of the rows named; a row outside [0, n_rows) is an error."""
    wrong = [r for r in rows if not 0 <= r < n_rows]
    if wrong:
        raise IndexError(f"rows {wrong[:5]} are not in [0, {n_rows})")
    return acts.where(F.col(row).isin(rows))


def with_batches(acts: DataFrame, size: int, n_rows: int, drop_last: bool = False, row: str = "row") -> DataFrame:
    """acts with a batch number; the last batch may be short, and be dropped."""
    found = acts.withColumn("batch", F.floor(F.col(row) / size).cast("long"))
    return found.where(F.col("batch") < n_rows // size) if drop_last else found


def limited(acts: DataFrame, size: int, n_rows: int, n: int, row: str = "row") -> DataFrame:
    """n samples by running over whole batches again and again: (epoch, row, ...)."""
    whole = n_rows // size * size
    if not whole:
        return acts.withColumn("epoch", F.lit(0)).where("false")
    epochs = F.explode(F.sequence(F.lit(0), F.lit(-(-n // whole) - 1)))
    return acts.where(F.col(row) < whole).withColumn("epoch", epochs).where(F.col("epoch") * whole + F.col(row) < n)


def write_store(acts: DataFrame, layout: Layout, path: str) -> DataFrame:
    """Writes (example_idx, token_idx, layer, act) by layer and shard, never an empty shard; returns the manifest
    (shard_idx, n_examples). One shuffle, by shard and layer."""
    placed = acts.withColumn("shard_idx", F.expr(f"example_idx div {layout.examples_per_shard}"))
    placed.repartition("layer", "shard_idx").sortWithinPartitions("example_idx", "token_idx").write.mode("overwrite").partitionBy("layer", "shard_idx").parquet(path)
    manifest = acts.sparkSession.read.parquet(path).groupBy("shard_idx").agg(F.countDistinct("example_idx").alias("n_examples"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}-manifest")
    return manifest


def check_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(name, problem) of all faults at once: a file that is missing or empty, or that the manifest lacks.
    manifest: (name); files: (name, length)."""
    both = manifest.select("name", F.lit(True).alias("listed")).join(files, "name", "full_outer")
    problem = F.when(F.col("length").isNull(), "missing").when(F.col("listed").isNull(), "not listed").when(F.col("length") == 0, "empty")
    return both.select("name", problem.alias("problem")).where(F.col("problem").isNotNull())


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of the files below a folder, empty ones too, which Spark's readers skip. Names are listed on
    the driver, as Spark does for any read; contents are not touched."""
    import fnmatch

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        status = files.next()
        name = status.getPath().getName()
        if fnmatch.fnmatch(name, pattern):
            found.append((status.getPath().toString(), name, status.getLen()))
    return spark.createDataFrame(found, "path string, name string, length long")


def image_folder(files: DataFrame, suffixes: tuple[str, ...] = (".png", ".jpg", ".jpeg")) -> DataFrame:
    """(path, label, target) of files in one folder a class; targets count the sorted classes from 0."""
    from pyspark.sql import Window

    kept = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*suffixes)).withColumn("label", F.regexp_extract("path", r"([^/]+)/[^/]*$", 1))
    classes = kept.select("label").distinct()
    targets = classes.withColumn("target", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))
    return kept.join(F.broadcast(targets), "label").select("path", "label", "target")


def label_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """(stem, label) of lines "stem label", split at the last space; a line without one is an error."""
    pattern = r"^(.*\S) (\S+)$"
    good = F.when(F.col(text).rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(F.raise_error(F.concat(F.lit("not a label line: "), F.col(text))))
    return lines.where(F.trim(text) != "").select(good.alias("stem"), F.regexp_extract(text, pattern, 2).alias("label"))


def fake_labels(spark: SparkSession, n_examples: int, tokens: int, n_classes: int, width: int = 0) -> DataFrame:
    """(example_idx, token_idx, label): (token + example) modulo the classes; the first `width` tokens are background 0."""
    rows = spark.range(n_examples).select(F.col("id").alias("example_idx"), F.explode(F.sequence(F.lit(0), F.lit(tokens - 1))).alias("token_idx"))
    value = (F.col("token_idx") + F.col("example_idx")) % n_classes
    return rows.withColumn("label", F.when(F.col("token_idx") < width, 0).otherwise(value).cast("int"))


def page_text(html: Column) -> Column:
    """The text of a page: scripts, styles and tags go, spaces are squeezed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


class FloatShards(DataSource):
    """Raw float32 shards as rows (shard, row, act). Options: paths (comma-separated, shared by all executors), dims."""

    @classmethod
    def name(cls) -> str:
        return "float_shards"

    def schema(self) -> str:
        return "shard int, row long, act array<float>"

    def reader(self, schema: object) -> DataSourceReader:
        return FloatShardReader(self.options)


class FloatShardReader(DataSourceReader):
    """One partition a shard; a shard is mapped, not loaded."""

    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for p in options["paths"].split(",") if p]
        self.dims = int(options["dims"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(self.paths))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        data = np.memmap(self.paths[partition.value], dtype="<f4", mode="r").reshape(-1, self.dims)
        each = max(1, (4 << 20) // (4 * self.dims))
        for start in range(0, len(data), each):
            part = np.ascontiguousarray(data[start : start + each])
            acts = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, self.dims, dtype=np.int32)), pa.array(part.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), partition.value, dtype=np.int32)), pa.array(np.arange(start, start + len(part))), acts], names=["shard", "row", "act"])


class ByteShards(DataSource):
    """Raw uint8 labels as rows (shard, row, label). Option: paths (comma-separated, shared by all executors)."""

    @classmethod
    def name(cls) -> str:
        return "byte_shards"

    def schema(self) -> str:
        return "shard int, row long, label int"

    def reader(self, schema: object) -> DataSourceReader:
        return ByteShardReader(self.options)


class ByteShardReader(DataSourceReader):
    """One partition a shard; a shard is mapped, not loaded."""

    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for p in options["paths"].split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(self.paths))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        data = np.memmap(self.paths[partition.value], dtype=np.uint8, mode="r")
        for start in range(0, len(data), 1 << 20):
            part = np.asarray(data[start : start + (1 << 20)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), partition.value, dtype=np.int32)), pa.array(np.arange(start, start + len(part))), pa.array(part)], names=["shard", "row", "label"])


class SparseShards(DataSource):
    """Compressed sparse rows in npz files (data, indices, indptr) as rows (shard, row, feature, value). Option: paths
    (comma-separated, shared by all executors)."""

    @classmethod
    def name(cls) -> str:
        return "sparse_shards"

    def schema(self) -> str:
        return "shard int, row long, feature int, value double"

    def reader(self, schema: object) -> DataSourceReader:
        return SparseShardReader(self.options)


class SparseShardReader(DataSourceReader):
    """One partition a shard."""

    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for p in options["paths"].split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(self.paths))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with np.load(self.paths[partition.value], allow_pickle=False) as found:
            data, indices, ends = found["data"], found["indices"], found["indptr"]
        rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        for start in range(0, len(data), 1 << 18):
            own = slice(start, start + (1 << 18))
            n = len(data[own])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, partition.value, dtype=np.int32)), pa.array(rows[own].astype(np.int64)), pa.array(indices[own].astype(np.int32)), pa.array(data[own].astype(np.float64))], names=["shard", "row", "feature", "value"])


def read_matrices(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(name, at, values) of the named matrices of an npz file, which Spark reads as a binary file."""
    schema = "name string, at long, values array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with np.load(io.BytesIO(content), allow_pickle=False) as found:
                    for name in names:
                        matrix = np.atleast_2d(found[name]).astype(np.float64)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(matrix)), pa.array(np.arange(len(matrix))), pa.array(matrix.tolist(), type=pa.list_(pa.float64()))], names=["name", "at", "values"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def numbered(df: DataFrame, label: str) -> DataFrame:
    """df with <label>_id: the number of each value among the sorted distinct ones, from 0."""
    from pyspark.sql import Window

    values = df.select(label).where(F.col(label).isNotNull()).distinct()  # a dimension
    ids = values.select(label, (F.row_number().over(Window.orderBy(label)) - 1).cast("int").alias(f"{label}_id"))
    return df.join(ids, label, "left")


def stem_join(images: DataFrame, masks: DataFrame, table: DataFrame, labels: list[str]) -> DataFrame:
    """(stem, image, mask, labels..., <label>_id...) of the stems that all three hold. images, masks: (path); table:
    (stem, labels...). A stem that one side holds twice is an error."""
    from glimmer.functions.columns import stem

    def once(df: DataFrame, what: str) -> DataFrame:
        seen = df.groupBy("stem").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in df.columns if c != "stem"))
        twice = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit(f"{what} holds a stem twice: "), F.col("stem"))).cast("boolean")).otherwise(F.lit(True))
        return seen.where(twice).drop("n")

    sides = (once(images.select(stem(F.col("path")).alias("stem"), F.col("path").alias("image")), "images"), once(masks.select(stem(F.col("path")).alias("stem"), F.col("path").alias("mask")), "masks"), once(table.select("stem", *labels), "the table"))
    found = sides[0].join(sides[1], "stem").join(sides[2], "stem")
    for label in labels:
        found = numbered(found, label)
    return found


def write_weights(spark: SparkSession, weights: Weights, path: str, header: dict) -> None:
    """A header as JSON and the weights as a relation (part, at, values): enc and dec by feature, biases as one row."""
    rows = [(part, i, [float(x) for x in row]) for part, matrix in (("enc", weights.enc), ("dec", weights.dec)) for i, row in enumerate(matrix)]
    rows += [("bias_enc", 0, [float(x) for x in weights.bias_enc]), ("bias_dec", 0, [float(x) for x in weights.bias_dec])]
    spark.createDataFrame(rows, "part string, at int, values array<double>").write.mode("overwrite").parquet(f"{path}/weights")
    spark.createDataFrame([(json.dumps(header, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def read_weights(spark: SparkSession, path: str) -> tuple[dict, Weights]:
    """What write_weights wrote. Headers without a schema number, or with one up to 5, are read; others are refused."""
    from glimmer.operators.encode import Weights

    header = json.loads(spark.read.text(f"{path}/header").first()["value"])
    if int(header.get("schema", 1)) > 5:
        raise ValueError(f"{path} has the newer schema {header['schema']}")
    found: dict[str, list] = {}
    for r in spark.read.parquet(f"{path}/weights").orderBy("part", "at").collect():  # weights, which are broadcast anyway
        found.setdefault(r["part"], []).append(r["values"])
    return header, Weights(np.array(found["enc"]), np.array(found["dec"]), np.array(found["bias_enc"][0]), np.array(found["bias_dec"][0]))
