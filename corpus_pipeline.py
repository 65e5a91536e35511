"""A corpus for training: toxic documents go, repeated lines go, one of each group of near-duplicates stays, documents
with benchmark passages go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. A document whose lines all go stays with an empty
text; near-duplicate removal then leaves one of these. Rows that repeat an identifier are one document and share a fate
in near-duplicate removal, as do all rows without one, which rank last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm.bpe import bpe_encode
from glimmer.llm.common import quoted, scratch_path
from glimmer.llm.decontaminate import drop_leaks
from glimmer.llm.jaccard import similar_texts
from glimmer.llm.lines import dedup_lines
from glimmer.llm.queries import RANKS, remainder, table
from glimmer.llm.simhash import contract, near_duplicates
from glimmer.llm.toxicity import drop_toxic


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; labels are learned from as in op2."""
    held_out = remainder(4)
    return drop_toxic(docs, table(spark, sf_dir, "labels"), lambda doc: ~held_out(doc))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document with a smaller identifier holds; n_chars follows the text."""
    kept = dedup_lines(docs, counts=None)
    return kept.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest identifier. Texts link if op1 links them, or
    if their sets of five-word shingles have a Jaccard similarity of at least 0.8."""
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    near = near_duplicates(keyed, key="key").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    least = contract(near.unionByName(similar_texts(keyed)))
    named = keyed.select("doc_id", "key").join(least, F.col("key") == F.col("a"), "left").select("doc_id", F.coalesce("b", "key").alias("component"))
    first = named.groupBy("component").agg(F.min("doc_id").alias("kept")).select("kept").distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["kept"]), "left_semi")


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten words in a row of a benchmark text."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): the token ids, and digests of them and of what they decode to."""
    import public_tokenizers

    decoded = bpe_encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decode=True)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_passages),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can express neither the network nor the merges; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.split()[0].lower()}")
        found = stage(spark, docs, sf_dir)
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return docs
