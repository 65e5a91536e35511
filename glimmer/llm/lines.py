"""Line deduplication with levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, A to Z in lower case; keys of at least ten code points count.
State is a set of runs: tables of (128-bit key hash, first document), bucketed by hash and sorted within each bucket, with
no hash in two of them. A batch of documents reduces its lines to one row for each hash in the same buckets and in order,
merges with the runs one after another without moving them, keeps what they lack (an anti-join), and adds that as a new
run. When a level has as many runs as the fan-out, they are merged into one run of the next level, bucket by bucket, so a
hash is rewritten once for each level.

Batches are ranges of ascending identifiers, so the first document of a key is the smallest that holds it. A key in one
document only loses nothing, however often it repeats there. The documents that lose a frequent line meet its owner by
broadcast, of at most MOST_FREQUENT lines; those of all others meet it by hash. Null texts are one empty line. Null
identifiers are one document that ranks last.
"""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from glimmer.llm.common import quoted, scratch_path, ship, slices, stage, text_bytes, to_batch

#: What is stripped from the ends of a line.
SPACE = b" \t\n\r\x0b\x0c"
#: Code points that a key has at least.
LEAST = 10
#: Lines of a batch that count as frequent at most: those in more than this part of its rows.
MOST_FREQUENT = 1000
#: Bytes of text for each bucket of the runs, and the most buckets that a table can have.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 100_000


def line_hash(line: bytes, least: int = LEAST) -> bytes | None:
    """The hash of the line's key; None if the key is too short to count."""
    import xxhash

    key = line.strip(SPACE).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return xxhash.xxh3_128_digest(key)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) for the plans that run inside; the old ones come back."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class LineRuns:
    """The levelled runs, kept in the shared folder; add() takes one batch after another."""

    def __init__(self, spark: SparkSession, buckets: int = 8, fan_out: int = 2) -> None:
        self.spark, self.buckets, self.fan_out = spark, buckets, fan_out
        self.levels: list[list[DataFrame]] = []
        self.names: list[str] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def write(self, rows: DataFrame) -> DataFrame:
        """rows, already dealt to the buckets by hash, as a table with one sorted file for each bucket."""
        name = f"glimmer_line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "hash").sortBy("hash").option("compression", "zstd").option("path", scratch_path(self.spark, "line-run")).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def add(self, batch: DataFrame) -> DataFrame:
        """batch: (hash, doc, mark) of lines. Returns (doc, mark, hash) of the lines that the batch loses; the runs then
        hold its hashes."""
        with settings(self.spark, spark__sql__shuffle__partitions=str(self.buckets), spark__sql__legacy__bucketedTableScan__outputOrdering="true", spark__sql__sources__bucketing__autoBucketedScan__enabled="false"):
            firsts = batch.groupBy("hash").agg(F.min("doc").alias("here"), F.count("*").alias("n"))
            first, known = F.lit(None).cast("long"), F.lit(False)
            for i, run in enumerate(self.runs()):
                firsts = firsts.join(run.select("hash", F.col("first").alias(f"first_{i}"), F.lit(True).alias(f"known_{i}")).hint("merge"), "hash", "left")
                first, known = F.coalesce(first, F.col(f"first_{i}")), known | F.coalesce(F.col(f"known_{i}"), F.lit(False))
            met = self.write(firsts.select("hash", "here", "n", first.alias("first"), known.alias("known")))
            if not self.levels:
                self.levels.append([])
            self.levels[0].append(met.where(~F.col("known")).select("hash", F.col("here").alias("first")))
            self.compact()
        owners = met.where(F.col("known") | (F.col("n") > 1)).select("hash", F.when(F.col("known"), F.col("first")).otherwise(F.col("here")).alias("owner"), "n")
        return stage(self.losses(batch, owners), "line-lost")

    def losses(self, batch: DataFrame, owners: DataFrame) -> DataFrame:
        cut = max(MOST_FREQUENT, batch.count() // MOST_FREQUENT)
        often = F.broadcast(owners.where(F.col("n") > cut))  # fewer than MOST_FREQUENT rows, as each stands for more than cut rows of the batch
        few = batch.join(often, "hash", "left_anti").join(owners.where(F.col("n") <= cut), "hash")
        met = few.unionByName(batch.join(often, "hash"))
        return met.where(~F.col("doc").eqNullSafe(F.col("owner"))).select("doc", "mark", "hash")

    def compact(self) -> None:
        """Merges full levels downwards: a full outer join on the sorted hashes, which no two runs share."""
        at = 0
        while at < len(self.levels) and len(self.levels[at]) >= self.fan_out:
            merged = reduce(lambda a, b: self.write(a.join(b.hint("merge"), "hash", "full").select("hash", F.coalesce(a["first"], b["first"]).alias("first"))), self.levels[at])
            self.levels[at] = []
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(merged)
            at += 1

    def close(self) -> None:
        """Takes the runs out of the catalog; their files go with the other scratch files."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def mark_of(key: Column, text: Column) -> Column:
    """Tells rows without identifier apart by their texts; zero for all others."""
    return F.when(key.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def line_table(docs: DataFrame, key: str, text: str, least: int, edges: list[int]) -> DataFrame:
    """(doc, mark, hash, batch) of the distinct lines that count in each row; the edges are the last identifiers of all
    batches but the last."""
    schema = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("hash", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, marks, hashes = [], [], []
            for doc, mark, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                found = {line_hash(line, least) for line in raw.split(b"\n")} - {None}
                ids += [doc] * len(found)
                marks += [mark] * len(found)
                hashes += found
            yield to_batch({"doc": ids, "mark": marks, "hash": hashes}, schema)

    doc, content = F.col(quoted(key)).cast("long"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    lines = docs.select(doc.alias("doc"), mark_of(doc, content).alias("mark"), content.alias("text")).mapInArrow(run, "doc long, mark long, hash binary")
    number = F.coalesce(reduce(lambda a, b: a + b, [(F.col("doc") > edge).cast("int") for edge in edges], F.lit(0)), F.lit(len(edges)))
    return lines.withColumn("batch", number)


def dedup_lines(docs: DataFrame, batch_bytes: int = 128 << 20, batches: tuple[int, int] = (4, 16), fan_out: int = 2, least: int = LEAST, key: str = "doc_id", text: str = "text", counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """All columns of docs with the text rewritten (null becomes empty), and the numbers of lines before and of lines
    dropped under the two names in counts, which replace columns of these names; without counts nothing is added.

    A table is cut into batches of ascending identifiers of about batch_bytes of text, but into at least batches[0] and
    at most batches[1]; each adds to the runs. So a hash meets log2(batches[1]) runs at most, however large the table. The texts pass through one exchange, to meet the hashes that they lose; a line is
    only ever moved as its hash."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(*(counts or ()))
    size = text_bytes(docs, text)
    n = max(batches[0], min(batches[1], math.ceil(size / batch_bytes)))
    doc = F.col(quoted(key)).cast("long")
    edges = sorted({int(x) for x in docs.select(doc.alias("doc")).approxQuantile("doc", [i / n for i in range(1, n)], 0.01)}) if n > 1 else []
    path = scratch_path(spark, "lines")
    line_table(docs, key, text, least, edges).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema("doc long, mark long, hash binary, batch int").parquet(path)
    runs = LineRuns(spark, max(8, min(MOST_BUCKETS, size // BUCKET_BYTES)), fan_out)
    try:
        lost = [runs.add(lines.where(F.col("batch") == i).drop("batch")) for i in range(len(edges) + 1)]
    finally:
        runs.close()
    dropped = reduce(DataFrame.unionByName, lost).groupBy("doc", "mark").agg(F.collect_list("hash").alias("lost"))
    content = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    own = docs.select(*(content.alias(c) if c == text else F.col(quoted(c)) for c in docs.columns))
    names = [f"c{i}" for i in range(len(own.columns))]
    plain = own.toDF(*names).withColumns({"key": F.col(names[own.columns.index(key)]).cast("long"), "side": mark_of(F.col(names[own.columns.index(key)]), F.col(names[own.columns.index(text)]))})
    met = plain.join(dropped.hint("shuffle_hash"), plain["key"].eqNullSafe(dropped["doc"]) & (plain["side"] == dropped["mark"]), "left").select(*names, "lost")
    at, out_names = own.columns.index(text), [*own.columns, *(counts or ())]

    def rewrite(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts, n_lines, n_dropped = [], [], []
            for raw, lost in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if not lost:
                    texts.append(raw)
                    n_lines.append(raw.count(b"\n") + 1)
                    n_dropped.append(0)
                    continue
                parts, gone = raw.split(b"\n"), set(lost)
                kept = [line for line in parts if line_hash(line, least) not in gone]
                texts.append(b"\n".join(kept))
                n_lines.append(len(parts))
                n_dropped.append(len(parts) - len(kept))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[at] = pa.array(texts, type=pa.binary()).cast(batch.schema.field(at).type)
            more = [pa.array(n_lines, type=pa.int64()), pa.array(n_dropped, type=pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays([*columns, *more], names=out_names)

    return met.mapInArrow(rewrite, StructType([*own.schema.fields, *(StructField(c, LongType()) for c in counts or ())]))
