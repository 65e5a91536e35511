"""Checkpoint files: a JSON header on the first line, then a binary payload with the weights.

Headers of all schemas come out in one form. Files without a schema hold bare settings and mean ReLU; schema 1 names the
activation by the header's class, or as an object among the settings; schemas 2 to 4 hold it as an object, in which older
names are still accepted; schema 5 holds it as an object with today's names. Settings that no longer exist are dropped,
and a factor of expansion becomes the number of features. Other schemas are refused.

The payload is an npz archive, or the zip archive of a framework's saved state: a pickle, of which only tensors of plain
numbers in ordered dictionaries are read (anything else is refused, nothing is executed), and raw storages.
"""

from __future__ import annotations

import io
import json
import pickle
import zipfile
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.sources.files import written_files

#: Settings of old files that mean nothing now; the names of activations; old names of an activation's fields.
DROPPED = ("sparsity_coeff", "ghost_grads", "l1_coeff", "use_ghost_grads", "seed", "n_reinit_samples")
ACTIVATIONS = ("Relu", "TopK", "BatchTopK")
RENAMED = {"kind": "key"}
#: Of schema 1, what a file without a number of kept values means.
TOP_K = 32
#: Kinds of numbers in storages.
STORAGES = {"FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "LongStorage": "<i8", "IntStorage": "<i4"}
#: Names of the weights in a payload, and whether their rows are dimensions, not features.
PARTS = {"W_enc": ("enc", True), "W_dec": ("dec", False), "b_enc": ("bias_enc", False), "b_dec": ("bias_dec", False)}

ROWS = "path string, schema int, d_model long, d_sae long, activation string, top_k int, settings string, part string, at int, values array<double>"


def settled(header: dict) -> dict:
    """(schema, d_model, d_sae, activation, top_k, settings) of a header of any schema; schema 0: none was given."""
    schema = header.get("schema", 0)
    if schema not in range(6):
        raise ValueError(f"schema {schema} is not known")
    cfg = dict(header["cfg"]) if schema else dict(header)
    if not schema:
        cfg["d_model"], activation = cfg.pop("d_vit"), {"cls": "Relu", "params": {}}
    elif schema == 1 and header.get("cls") in ACTIVATIONS:
        activation = {"cls": header["cls"], "params": {} if header["cls"] == "Relu" else {"top_k": cfg.pop("top_k", TOP_K)}}
    elif schema == 1 and "activation" not in cfg:
        activation = {"cls": "TopK", "params": {"top_k": TOP_K}}
    else:
        activation = cfg.pop("activation")
    for name in DROPPED:
        cfg.pop(name, None)
    factor = cfg.pop("exp_factor", None)
    if "d_sae" not in cfg:
        if factor is None or cfg.get("d_model") is None:
            raise ValueError("the number of features is not given")
        cfg["d_sae"] = cfg["d_model"] * factor
    if activation.get("cls") not in ACTIVATIONS or not isinstance(activation.get("params"), dict):
        raise ValueError(f"activation {activation.get('cls')} is not known")
    params = {}
    for name, value in activation["params"].items():
        name = RENAMED.get(name, name)
        if name in params:
            raise ValueError(f"{name} is given twice")
        params[name] = value
    top_k = params.pop("top_k", None)
    more = cfg | ({"activation": params} if params else {})
    d_model, d_sae = more.pop("d_model"), more.pop("d_sae")
    return {"schema": schema, "d_model": d_model, "d_sae": d_sae, "activation": activation["cls"], "top_k": top_k, "settings": json.dumps(more, sort_keys=True)}


class State(pickle.Unpickler):
    """Reads ordered dictionaries of tensors, and nothing else."""

    def __init__(self, archive: zipfile.ZipFile, top: str) -> None:
        super().__init__(io.BytesIO(archive.read(f"{top}/data.pkl")))
        self.archive, self.top = archive, top

    def find_class(self, module: str, name: str) -> object:
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return lambda storage, offset, size, stride, *_: np.lib.stride_tricks.as_strided(storage[offset:], size, [s * storage.itemsize for s in stride]).copy()
        if module == "torch" and name in STORAGES:
            return name
        raise pickle.UnpicklingError(f"{module}.{name} is no part of a checkpoint")

    def persistent_load(self, pid: tuple) -> np.ndarray:
        _, kind, key, _, n = pid
        return np.frombuffer(self.archive.read(f"{self.top}/data/{key}"), dtype=STORAGES[kind])[:n]


def payload(content: bytes) -> dict[str, np.ndarray]:
    """The arrays of a payload by name."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        states = [n for n in archive.namelist() if n.endswith("/data.pkl")]
        if states:
            return dict(State(archive, states[0].removesuffix("/data.pkl")).load())
    with np.load(io.BytesIO(content), allow_pickle=False) as found:
        return {name: found[name] for name in found.files}


def split_file(content: bytes) -> tuple[dict, bytes]:
    """(header, payload) of a file."""
    line, found, rest = content.partition(b"\n")
    if not found:
        raise ValueError("the file holds no payload")
    return json.loads(line), rest


def checkpoint_bytes(header: dict, arrays: dict[str, np.ndarray]) -> bytes:
    """A file with an npz payload."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    return json.dumps(header).encode() + b"\n" + out.getvalue()


def write_checkpoints(files: DataFrame, folder: str) -> None:
    """files: (name, content), each written as one file below the folder, in tasks."""
    written_files(files, folder).count()


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """(ROWS) of all files of a path: a row of weights for each feature (enc, dec) and one for each bias, beside the
    file's settings. Files are read by tasks; a file is held whole by one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"path": pa.string(), "schema": pa.int32(), "d_model": pa.int64(), "d_sae": pa.int64(), "activation": pa.string(), "top_k": pa.int32(), "settings": pa.string(), "part": pa.string(), "at": pa.int32(), "values": pa.list_(pa.float64())}
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    header, rest = split_file(content)
                    head, arrays = settled(header), payload(rest)
                    for weight, (part, turned) in PARTS.items():
                        matrix = np.atleast_2d(np.asarray(arrays[weight], dtype=np.float64))
                        matrix = matrix.T if turned else matrix
                        want = {"enc": (head["d_sae"], head["d_model"]), "dec": (head["d_sae"], head["d_model"]), "bias_enc": (1, head["d_sae"]), "bias_dec": (1, head["d_model"])}[part]
                        if matrix.shape != want:
                            raise ValueError(f"{weight} has the shape {matrix.shape}, not {want}")
                        for start in range(0, len(matrix), 1024):
                            own = matrix[start : start + 1024]
                            values = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(own).reshape(-1)))
                            fixed = {"path": name, **head, "part": part}
                            columns = {k: pa.array([fixed[k]] * len(own), type=t) for k, t in kinds.items() if k in fixed}
                            columns |= {"at": pa.array(np.arange(start, start + len(own), dtype=np.int32)), "values": values}
                            yield pa.RecordBatch.from_arrays([columns[k] for k in kinds], names=list(kinds))
                except (ValueError, KeyError, pickle.UnpicklingError, zipfile.BadZipFile) as e:
                    raise ValueError(f"{name}: {e}") from e

    return spark.read.format("binaryFile").load(path).select(F.col("path"), "content").mapInArrow(run, ROWS)
