"""Readers and writers of tables around the store, with the rules that their files need."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | None = None, null: str = "?", separator: str = ",", lower: bool = True) -> DataFrame:
    """A table with a header; ragged lines are filled or cut, `null` marks missing values, names are put in lower case.
    Without a schema types are inferred, which reads the file twice."""
    read = spark.read.option("header", True).option("sep", separator).option("nullValue", null).option("mode", "PERMISSIVE")
    found = read.schema(schema).csv(path) if schema else read.option("inferSchema", True).csv(path)
    return found.toDF(*(c.strip().lower() for c in found.columns)) if lower else found


def read_parts(spark: SparkSession, root: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet with folders name=value as columns; only the columns named are read."""
    found = spark.read.parquet(root)
    return found.select(*columns) if columns else found


def read_results(spark: SparkSession, pattern: str, schema: str | None = None, prefix: str = "") -> DataFrame:
    """JSON results, one object a file, with the file's name; only files whose name starts with the prefix."""
    read = spark.read.option("multiLine", True)
    found = (read.schema(schema) if schema else read).json(pattern).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1))
    return found.where(F.col("file").startswith(prefix)) if prefix else found


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of a tab-separated class table with a header."""
    found = spark.read.option("header", True).option("sep", "\t").csv(path)
    key, name = found.columns[:2]
    return found.select(F.col(key).try_cast("int").alias("id"), F.col(name).alias("name"))


def read_metadata(spark: SparkSession, path: str, required: tuple[str, ...]) -> dict:
    """One JSON object; all missing keys are named at once."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    found = json.loads(rows[0]["value"])
    missing = [k for k in required if k not in found]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return found


def resolve_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """df's columns by the first alias that it has; a name without any is an error."""
    picked = {}
    for name, options in aliases.items():
        there = [o for o in options if o in df.columns]
        if not there:
            raise ValueError(f"none of {options} for {name}")
        picked[name] = there[0]
    return df.select(*(F.col(f"`{c}`").alias(name) for name, c in picked.items()))


def scalar_columns(df: DataFrame) -> DataFrame:
    """The columns that hold neither lists nor structs nor maps."""
    return df.select(*(F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))))


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """Struct fields as columns with joined names, at any depth."""

    def leaves(kind: T.DataType, path: list[str]) -> list[list[str]]:
        if isinstance(kind, T.StructType):
            return [leaf for f in kind for leaf in leaves(f.dataType, [*path, f.name])]
        return [path]

    paths = [leaf for f in df.schema for leaf in leaves(f.dataType, [f.name])]
    return df.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path)) for path in paths))


def pending(work: DataFrame, sink: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of work whose keys the sink lacks: what a resumed run still has to do."""
    return work.join(sink.select(*keys).distinct(), keys, "left_anti")


def write_once(df: DataFrame, path: str, force: bool = False) -> bool:
    """Writes Parquet unless it is there already with its marker; whether it wrote."""
    spark = df.sparkSession
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not force and marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_manifest(files: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in order, one file: a manifest is small."""
    files.orderBy(*order).coalesce(1).write.mode("overwrite").json(path)


def write_artifacts(frames: dict[str, DataFrame], folder: str, force: bool = False, only: str | None = None) -> list[str]:
    """Writes a set of tables below a folder, each under its name, and returns the names written. Nothing is written if all
    are there already, unless forced; only: the one table to write, such as the metrics."""
    wanted = {only: frames[only]} if only else frames
    return [name for name, df in wanted.items() if write_once(df, f"{folder}/{name}", force)]
