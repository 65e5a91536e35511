"""A deterministic sharded WARC writer, and a reader.

Records are sorted by identifier and, below it, by digest. Shards are ranges of this order with about equal bytes, cut by
exact running sums and so the same in each run; a shard is a sequence of files, each closed when its compressed size
reaches a limit. Every record is a gzip member of its own. Headers, identifiers and digests are made from the content
alone. Of records with equal payloads of at least `least` bytes the one with the smallest identifier is a response, the
others are revisits that name it.

Each call of the writer has a folder of its own below `out`. Tasks write files under temporary names that no other task
uses; Spark's own commit tells which of them count. These get their final names, a manifest with sizes and digests is
written, and an empty marker whose name holds a number and the folder's name commits all at once. Readers take the marker
with the highest number, read the files that the manifest names and check every digest; so a folder may be written
again, and readers see the former archive until the new marker is there. Former folders are left to the caller. Files
are opened through pyarrow's file systems on the executors, so `out` may be local to all, or in a store that pyarrow
knows.

A null payload is empty. A null identifier ranks last and has no header; rows that repeat an identifier with the same
payload are alike. An empty table gives a manifest without files.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.llm.common import quoted, ship, slices, stage

#: Shards at most; of a larger table each holds more bytes.
MOST_SHARDS = 100_000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE_OF_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
WRITTEN = "hidden string, shard int, part int, name string, n_bytes long, n_records long, sha256 string"
MANIFEST = "shard int, part int, name string, n_bytes long, n_records long, sha256 string"


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_OF_IDS, f'{page}/{digest}')}>"


def clean(value: str | None) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value or "about:blank")


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit if refers_to is given; the length of the payload is in its HTTP headers either way."""
    headers = [("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", clean(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page is not None:
        headers.append(("X-Page-Id", str(page)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return record("response", headers, http + payload)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    return record("revisit", headers, http)


def store_of(path: str) -> tuple:
    """(pyarrow's file system, the path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Files:
    """The files of one shard, one open at a time and held in memory up to the limit."""

    def __init__(self, out: str, shard: int, most_bytes: int) -> None:
        self.store, self.folder = store_of(out)
        self.shard, self.most, self.part, self.rows = shard, most_bytes, 0, []
        self.open()

    def open(self) -> None:
        self.buffer, self.count = io.BytesIO(), 0
        name = f"part-{self.shard:06d}-{self.part:05d}.warc.gz"
        info = f"software: glimmer\r\nformat: WARC File Format 1.1\r\nfile: {name}\r\n".encode()
        self.buffer.write(record("warcinfo", [("WARC-Record-ID", record_id(None, name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))
        self.name = name

    def add(self, member: bytes) -> None:
        self.buffer.write(member)
        self.count += 1
        if self.buffer.tell() >= self.most:
            self.close()
            self.part += 1
            self.open()

    def close(self) -> None:
        """Writes what is open under a name of its own."""
        if not self.count:
            return
        content, hidden = self.buffer.getvalue(), f"{uuid.uuid4().hex}-{self.name}"
        with self.store.open_output_stream(f"{self.folder}/_temporary/{hidden}", compression=None) as out:
            out.write(content)
        self.rows.append((hidden, self.shard, self.part, self.name, len(content), self.count, hashlib.sha256(content).hexdigest()))
        self.count = 0


def order_key(page: Column, digest: Column) -> Column:
    """Text that sorts as (page, nulls last; digest)."""
    return F.concat(F.coalesce(F.lpad(F.hex(page.bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit("X")), digest)


def shard_bounds(records: DataFrame, shard_bytes: int) -> list[str]:
    """The first key of each shard but the first, from (key, n): records begin a new shard where the sum of all bytes
    before them passes a multiple of shard_bytes. One number a partition and one key a shard reach the driver."""
    ranged = stage(records.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ranged")
    sums = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    shard_bytes = max(shard_bytes, -(-sum(n for _, n in sums) // MOST_SHARDS))
    before, held = {}, 0
    for part, n in sums:
        before[part], held = held, held + n
    offsets = F.broadcast(records.sparkSession.createDataFrame(sorted(before.items()), "part int, before long"))
    running = F.sum("n").over(Window.partitionBy("part").orderBy("key", "n").rowsBetween(Window.unboundedPreceding, -1))
    shard = F.floor((F.col("before") + F.coalesce(running, F.lit(0))) / shard_bytes)
    firsts = ranged.join(offsets, "part").withColumn("shard", shard).groupBy("shard").agg(F.min("key").alias("key")).collect()
    return sorted({r["key"] for r in firsts})[1:]


def write_warc(pages: DataFrame, out: str, least: int = 100, file_bytes: int = 16 << 20, shard_bytes: int = 16 << 20, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes pages to the folder `out`; returns the manifest: shard, part, name, n_bytes, n_records, sha256. The payloads
    are read twice, once for their digests, and pass through one exchange."""
    spark = pages.sparkSession
    ship(spark)
    folder = f"{out}/archive-{uuid.uuid4().hex}"
    store, at = hadoop(spark, out)
    store.mkdirs(at(f"{folder}/_temporary"))
    payload = F.coalesce(F.col(quoted(html)).cast("string"), F.lit("")).cast("binary")
    plain = pages.select(F.col(quoted(key)).cast("long").alias("page"), F.col(quoted(url)).cast("string").alias("url"), payload.alias("payload"))
    plain = plain.withColumn("digest", F.sha2("payload", 256)).withColumn("key", order_key(F.col("page"), F.col("digest")))
    small = stage(plain.select("page", "digest", "key", F.octet_length("payload").cast("long").alias("n")), "digests")
    bounds = np.array(shard_bounds(small.select("key", "n"), shard_bytes), dtype=bytes)
    held = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def shard_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, key.to_numpy().astype(bytes), side="right").astype(np.int32))

    firsts = small.where(F.col("n") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null").select("digest", "first")
    later = small.join(firsts, "digest").where(F.col("page").isNull() | (F.col("page") > F.col("first")))
    # a row that says what a page refers to comes just before the page, so the payloads are moved once
    marks = later.select("page", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", F.col("first").alias("refers_to"), "key").distinct()
    records = plain.select("page", "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to"), "key").unionByName(marks).withColumn("shard", shard_of("key"))
    dealt = records.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "key", F.col("refers_to").asc_nulls_last(), "url")
    schema = pa.schema([("hidden", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("name", pa.string()), ("n_bytes", pa.int64()), ("n_records", pa.int64()), ("sha256", pa.string())])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, mark = None, None

        def rows(done: Files) -> pa.RecordBatch:
            done.close()
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*done.rows, strict=True) if done.rows else [[]] * len(schema), schema, strict=True)], schema=schema)

        for batch in batches:
            for row in (r for part in slices([batch.rename_columns(["page", "url", "text", "digest", "refers_to", "shard"])]) for r in part.to_pylist()):
                if files is None or files.shard != row["shard"]:
                    if files is not None:
                        yield rows(files)
                    files = Files(folder, row["shard"], file_bytes)
                if row["refers_to"] is not None:
                    mark = row
                    continue
                known = mark is not None and (mark["page"], mark["digest"]) == (row["page"], row["digest"])
                files.add(page_record(row["page"], row["url"], row["text"], row["digest"], mark["refers_to"] if known else None))
        if files is not None:
            yield rows(files)

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = store_of(folder)
        for batch in batches:
            for hidden, name in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                target = f"{top}/{name}"
                try:
                    if store.get_file_info(target).type == fs.FileType.NotFound:
                        store.move(f"{top}/_temporary/{hidden}", target)
                except OSError:  # another run of this task was faster
                    if store.get_file_info(target).type == fs.FileType.NotFound:
                        raise
            yield batch.select(MANIFEST_COLUMNS)

    dealt.select("page", "url", "payload", "digest", "refers_to", "shard").mapInArrow(write, WRITTEN).write.json(f"{folder}/_written")
    spark.read.schema(WRITTEN).json(f"{folder}/_written").mapInArrow(settle, MANIFEST).write.json(f"{folder}/_manifest")
    store.delete(at(f"{folder}/_temporary"), True)
    number = 1 + max((n for n, _ in committed(spark, out)), default=0)
    store.create(at(f"{out}/_COMMITTED-{number:09d}-{folder.rpartition('/')[2]}"), False).close()
    return spark.read.schema(MANIFEST).json(f"{folder}/_manifest")


MANIFEST_COLUMNS = [part.split()[0] for part in MANIFEST.split(", ")]


def hadoop(spark: SparkSession, path: str) -> tuple:
    """(Hadoop's file system of a path, its class of paths)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def committed(spark: SparkSession, out: str) -> list[tuple[int, str]]:
    """(number, folder) of the markers in out."""
    store, at = hadoop(spark, out)
    names = [f.getPath().getName() for f in (store.globStatus(at(f"{out}/_COMMITTED-*")) or [])]
    return [(int(number), folder) for _, number, folder in (name.split("-", 2) for name in names)]


def members(content: bytes) -> Iterator[bytes]:
    """The gzip members of a file, unpacked one after another."""
    at, view = 0, memoryview(content)
    while at < len(content):
        unzip, out = zlib.decompressobj(wbits=31), []
        while not unzip.eof:
            if at >= len(content):
                raise ValueError("a gzip member is cut off")
            part = view[at : at + (1 << 14)]
            out.append(unzip.decompress(part))
            at += len(part) - len(unzip.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of a record; the block digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(headers["content-length"])]
    if headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("a block differs from its digest")
    return headers, block


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of the committed records; a
    revisit has no payload of its own."""
    ship(spark)
    found = committed(spark, out)
    if not found:
        raise FileNotFoundError(f"{out} holds no committed archive")
    folder = f"{out}/{max(found)[1]}"
    manifest = spark.read.schema(MANIFEST).json(f"{folder}/_manifest").select("name", "sha256")
    dealt = manifest.repartition(max(1, min(MOST_SHARDS, manifest.count())), "name")  # only names are moved, each task opens its files
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(folder)
        for batch in batches:
            for name, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{top}/{name}", compression=None) as file:
                    content = file.read()
                if hashlib.sha256(content).hexdigest() != digest:
                    raise ValueError("a file differs from the manifest")
                rows: list[dict] = []
                held = 0
                for data in members(content):
                    headers, block = parse(data)
                    kind = headers["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = headers["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != stated:
                        raise ValueError("a payload differs from its digest")
                    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                    rows.append({
                        "page_id": page and int(page), "url": headers["warc-target-uri"], "record_type": kind, "payload_bytes": int(http.rpartition(b"Content-Length: ")[2]),
                        "payload_digest": stated, "refers_to": refers and int(refers), "payload": payload if kind == "response" else None,
                    })
                    held += len(payload)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return dealt.mapInArrow(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
