"""The pipeline against a plain version of its stages, each on its own input."""

import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import DATA
from glimmer.llm import bpe
from glimmer.llm.decontaminate import FOLD
from glimmer.llm.queries import remainder, table
from glimmer.llm.toxicity import score_toxicity
from test_llm_brute import components, plain_fingerprint

SPACE = " \t\n\r\x0b\x0c"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of each stage, the input first."""
    docs, out = table(spark, DATA, "documents"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        path = f"file://{tmp_path_factory.mktemp('stage')}/{i}"
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(spark, stages):
    assert all(df.columns == stages[0].columns for df in stages[:5]) and "ids" in stages[5].columns
    assert corpus_pipeline.run(spark, DATA).select("doc_id", "ids_sha256").collect().__len__() == stages[5].count()


def test_toxic_documents_go(spark, stages):
    held = remainder(4)
    found = score_toxicity(stages[0], table(spark, DATA, "labels"), lambda doc: ~held(doc))
    assert sorted(texts(stages[1])) == sorted(r.doc_id for r in found.where("predicted = 0").collect())


def test_repeated_lines_go(stages):
    before, after, first = texts(stages[1]), texts(stages[2]), {}

    def key(line):
        return line.strip(SPACE).encode().lower()

    for i in sorted(before):
        for line in before[i].split("\n"):
            if len(key(line).decode()) >= 10:
                first.setdefault(key(line), i)
    assert after == {i: "\n".join(x for x in t.split("\n") if first.get(key(x), i) == i) for i, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_one_of_each_group_stays(stages):
    before = texts(stages[2])
    groups = components({i: plain_fingerprint(t) for i, t in before.items()})
    assert sorted(texts(stages[3])) == sorted(set(groups.values()))


def test_benchmark_passages_go(spark, stages):
    def words(text):
        return (text or "").encode().translate(FOLD).split()

    windows = set()
    for r in table(spark, DATA, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()

    def clean(text):
        w = words(text)
        return not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    before = texts(stages[3])
    assert sorted(texts(stages[4])) == sorted(i for i, t in before.items() if clean(t))


AWKWARD = [(1, "the same line of text\nanother line of text here", "a", "s", 40), (1, "the same line of text\nanother line of text here", "a", "s", 40), (2, "the same line of text\nanother line of text here", None, None, None), (3, None, None, None, None), (4, "", "a", "s", 0), (None, "the same line of text", "a", "s", 21), (None, None, None, None, None), (5, " \t\n\x0b", "a", "s", 4), (6, "many words of one very long text that goes on and on " * 20_000, "a", "s", 9), (7, "日本語のテキスト 😀", "a", "s", 9), (2**63 - 1, "only here, on a line of its own", "a", "s", 9)]
#: What stays of the awkward rows, stage by stage, each on the rows themselves.
STAY = {"toxicity": len(AWKWARD), "line dedup": len(AWKWARD), "byte-level BPE encoding and decoding": len(AWKWARD)}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_rows(spark, name, stage):
    """Nulls, empty and long texts, repeated rows, clashing extra columns; and an empty table."""
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("key", "component", "kept", "doc", "lost", "c0", "a`b.c", "n_lines", "n_email", "score"):
        docs = docs.withColumn(extra, F.lit(1))
    docs = docs.withColumn("N_Dropped", F.lit("keep"))
    found = stage(spark, docs, DATA)
    rows = found.collect()
    assert len(rows) == STAY.get(name, len(rows)) and {r.doc_id for r in rows} <= {r[0] for r in AWKWARD}
    if name != corpus_pipeline.STAGES[-1][0]:
        assert found.columns == docs.columns and found.schema["N_Dropped"].dataType.simpleString() == "string"
        assert {(r.n_lines, r.N_Dropped, r.n_email) for r in rows} <= {(1, "keep", 1)}
    if name == "SimHash near-dedup":
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 1, 3, 6, 7, 2**63 - 1]
        assert sum(r.doc_id is None for r in rows) == 2  # the text without number has no partner among the others
    if name == "benchmark decontamination":
        assert len(rows) == len(AWKWARD)
    if name == "line dedup":
        texts = sorted((str(r.doc_id), r.text) for r in rows if r.doc_id in (1, 2, None))
        assert texts == [("1", AWKWARD[0][1]), ("1", AWKWARD[0][1]), ("2", ""), ("None", ""), ("None", "")]
    empty = stage(spark, docs.where("doc_id < 0"), DATA)
    assert empty.collect() == [] and empty.columns == found.columns


def test_tokens(stages):
    ranks = bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before = texts(stages[4])
    for r in stages[5].collect():
        ids = library.encode_ordinary(before[r.doc_id])
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()
