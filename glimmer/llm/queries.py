"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm.bpe import bpe_encode
from glimmer.llm.common import scratch_path, stage
from glimmer.llm.decontaminate import find_leaks
from glimmer.llm.hmm import score_texts
from glimmer.llm.language import identify
from glimmer.llm.lines import dedup_lines
from glimmer.llm.merkle import folded, manifest
from glimmer.llm.pii import pseudonymise
from glimmer.llm.quality import quality_cascade
from glimmer.llm.simhash import near_duplicates
from glimmer.llm.suffixes import cut_repeats
from glimmer.llm.toxicity import score_toxicity
from glimmer.llm.turns import audits, damaged, repaired, transcripts
from glimmer.llm.warc import read_warc, write_warc

#: The rank file of the tokenizer, by its name in the tokenizers' package.
RANKS = "byte_bpe_50k.tiktoken"

#: The key of the query's pseudonyms; a real one comes from a secret store.
PSEUDONYM_KEY = "a key for tests"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(column: F.Column) -> F.Column:
    return F.sha2(column, 256)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def remainder(n: int) -> Callable[[F.Column], F.Column]:
    """Of an identifier, whether crc32 of its text leaves 2 when divided by n."""
    return lambda doc: F.crc32(doc.cast("string").cast("binary")) % n == 2


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(4)
    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda doc: ~held_out(doc))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), remainder(7))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha(F.array_join("items", ",").cast("binary")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), sha("kept").alias("kept_sha256"))


def fails_base(x) -> bool:
    """Whether a measured text is too short or mostly repeated windows."""
    return x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = quality_cascade(table(spark, sf_dir, "documents"), measures=measures, fails=fails_base)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", *measures, failed.alias("base_failed"), "kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", sha(F.col("text").cast("binary")).alias("kept_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    decoded = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decode=True)
    return decoded.select("doc_id", "n_tokens", sha("ids").alias("ids_sha256"), sha(F.col("decoded").cast("binary")).alias("decoded_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, more).otherwise(F.col("n_chars").cast("string"))
    found = manifest(docs, other=[F.col("doc_id"), F.col("source"), F.col("lang"), changed, F.col("text")])
    digests = folded(found.select("doc_id", "leaf", "subroot", "root", "proof", "other"), "other")
    return digests.select("doc_id", *(F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    turns = damaged(original)
    found = stage(audits(turns, every=original), "audits")
    told = transcripts(repaired(turns, found)).withColumnRenamed("conv", "own")
    met = found.join(told, F.col("conv").eqNullSafe(F.col("own")), "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return met.select(
        F.col("conv").alias("conv_id"), F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0)).alias("illegal"), "cost", "audit", F.coalesce("repaired_sha256", none).alias("repaired_sha256")
    )


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = lambda doc: F.crc32(doc.cast("string").cast("binary")) % 5
    found = identify(table(spark, sf_dir, "documents"), lambda doc: rest(doc) != 0)
    return found.select("doc_id", F.coalesce(rest(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_hmm, op4_decontaminate, op5_suffix_dedup, op6_quality, op7_pii, op8_line_dedup, op9_byte_bpe, op10_warc, op11_merkle, op12_turns, op13_language)}
