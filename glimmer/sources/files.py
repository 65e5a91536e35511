"""Checks of files against what a manifest says of them: opened, counted and hashed in chunks, by tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from glimmer.sources.shards import store_of

#: Bytes that are read at a time.
CHUNK = 4 << 20


def verdict(store, path: str, size: int | None, digest: str | None) -> tuple[str, int | None]:
    """(status, bytes) of one file; size and digest: what is expected, null if nothing is."""
    from pyarrow import fs

    try:
        found = store.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            return "missing", None
        if found.type != fs.FileType.File:
            return "not a file", None
        if not found.size:
            return ("ok" if size == 0 else "empty"), 0
        sha, held = hashlib.sha256(), 0
        with store.open_input_stream(path, compression=None) as file:
            while chunk := file.read(CHUNK):
                sha.update(chunk)
                held += len(chunk)
    except OSError:
        return "unreadable", None
    if size is not None and held != size:
        return "wrong size", held
    return ("wrong digest" if digest is not None and sha.hexdigest() != digest else "ok"), held


def checked_files(expected: DataFrame, folder: str, tasks: int = 64) -> DataFrame:
    """expected: (name, bytes long, sha256 string), nulls where nothing is known. Returns (name, status, bytes): ok, missing,
    not a file, empty, unreadable, wrong size or wrong digest. Files are dealt to tasks by name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(folder)
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = [verdict(store, f"{top}/{name}", size, digest) for name, size, digest in zip(names, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), pa.array([s for s, _ in found], type=pa.string()), pa.array([n for _, n in found], type=pa.int64())], names=["name", "status", "bytes"])

    return expected.select("name", "bytes", "sha256").repartition(tasks, "name").mapInArrow(run, "name string, status string, bytes long")


def written_files(files: DataFrame, folder: str) -> DataFrame:
    """files: (name, content binary), each written as one file below the folder, under a temporary name first. Returns
    (name, bytes, sha256) of what was written; writing happens when this is computed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(folder)
        store.create_dir(top)
        for batch in batches:
            names, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, content in zip(names, contents, strict=True):
                with store.open_output_stream(f"{top}/.{name}.part", compression=None) as out:
                    out.write(content)
                store.move(f"{top}/.{name}.part", f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), pa.array([len(c) for c in contents], type=pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in contents], type=pa.string())], names=["name", "bytes", "sha256"])

    return files.select("name", "content").mapInArrow(run, "name string, bytes long, sha256 string")
