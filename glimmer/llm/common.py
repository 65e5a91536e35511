"""What the operators of this subpackage share: scratch tables, blocks of documents, shipping of code.

Conventions that hold for all of them:

* They read the columns they name and no others, so extra columns with any name are harmless.
* A null text is an empty text. A null identifier is a document of its own kind: it is returned
  with a null identifier and ranks after every other document.
* Rows that repeat an identifier stay separate rows of the result but count as one document.
* An empty table gives an empty result with the full schema.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import io
import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch.
MOST_ROWS = 2000

_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application; and has Arrow batches hold at most MOST_ROWS rows,
    as whole texts in batches of Spark's default length take much memory on both sides."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > MOST_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(MOST_ROWS))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(top)
    folder = tempfile.TemporaryDirectory(prefix=f"{name}-code-")
    _LOCAL[context.applicationId] = folder
    archive = os.path.join(folder.name, f"{name}_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for at, _, files in os.walk(top):
            for file in sorted(files):
                if file.endswith(".py"):
                    path = os.path.join(at, file)
                    out.write(path, os.path.join(name, os.path.relpath(path, top)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one, but only if all
    tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = f"scratch-{spark.sparkContext.applicationId}"
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.TemporaryDirectory(prefix="glimmer-")
        atexit.register(_LOCAL[key].cleanup)
    return f"file://{_LOCAL[key].name}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/glimmer-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later readers neither recompute it nor depend on
    the executors that made it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, text: str) -> int:
    """The bytes of all texts, counted: sizes of files say little of texts that compress well."""
    return int(df.agg(F.sum(F.octet_length(F.col(quoted(text)).cast("string")))).first()[0] or 0)


def count_blocks(df: DataFrame, block_bytes: int, least: int = 16, text: str = "text") -> int:
    """How many blocks of about block_bytes of text df falls into."""
    return max(least, math.ceil(text_bytes(df, text) / block_bytes))


def documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that matter, as (doc_id long, text string not null)."""
    return df.select(F.col(quoted(key)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df in this order, written to the shared folder, with places from 0. Rows are dealt by ranges of the order, equal
    ones too, so no range outgrows a task; of each range its size reaches the driver."""
    spark = df.sparkSession
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*order, F.col("__tie")).sortWithinPartitions(*order, F.col("__tie")).drop("__tie").withColumn("__at", F.monotonically_increasing_id())
    dealt = stage(dealt, "placed")
    part = F.shiftright("__at", 33)  # the range; the lower 33 bits are the row's number in it
    before, held = [], 0
    for row in sorted(dealt.groupBy(part.alias("part")).count().collect()):
        before.append((row[0], held))
        held += row[1]
    starts = F.broadcast(spark.createDataFrame(before, "__part long, __before long"))
    return dealt.withColumn("__part", part).join(starts, "__part").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__before", "__at")


def quoted(name: str) -> str:
    """A column's name for expressions, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def trim() -> None:
    """Gives memory that is free back to the system: a worker lives on after its task, beside those of later ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about most_bytes at most (one row at least); free memory goes back at the end."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if batch.nbytes <= most_bytes:
            yield batch
            continue
        column = batch.column(batch.schema.get_field_index("text"))
        ends = np.cumsum(np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64))
        start = 0
        while start < n:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    trim()


def keep_rows(docs: DataFrame, text: str, make: Callable[[], Callable[[list[bytes]], np.ndarray]]) -> DataFrame:
    """The rows of docs, all columns, for whose texts (null: empty) the function that make() returns on the executors
    is true. No exchange."""
    docs_names = list(docs.columns)
    at = docs_names.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide, names = make(), docs_names
        for part in slices(b.rename_columns([f"c{i}" if i != at else "text" for i in range(len(names))]) for b in batches):
            keep = decide(utf8(part.column(at)))
            yield part.filter(pa.array(np.asarray(keep, dtype=bool))).rename_columns(names)

    return docs.toDF(*(f"c{i}" for i in range(len(docs_names)))).mapInArrow(run, docs.schema)  # whatever characters names hold


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pack(array: np.ndarray) -> bytes:
    """An array as zstd-compressed bytes."""
    return bytes(pa.compress(np.ascontiguousarray(array).tobytes(), codec="zstd", asbytes=True)) if array.size else b""


def unpack(blob: bytes, size: int, dtype) -> np.ndarray:
    """The array of so many items that pack() made."""
    if not size:
        return np.zeros(0, dtype=dtype)
    return np.frombuffer(pa.decompress(blob, decompressed_size=size * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype=dtype)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string such as "doc_id long, score double"."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(","))])


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of this schema from a list or array for each column."""
    arrays = []
    for field in schema:
        values = columns[field.name]
        arrays.append(values if isinstance(values, pa.Array) and values.type == field.type else pa.array(values, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def npy(**arrays: np.ndarray) -> bytes:
    """Named arrays as one byte string, without pickling."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def from_npy(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob), allow_pickle=False) as found:
        return {k: found[k] for k in found.files}
