"""The awkward inputs, for every operator: nulls, empty and very long texts, ties, repeated rows, an empty table, and extra
columns with clashing names."""

import uuid

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from glimmer.llm import lines
from glimmer.llm.bpe import bpe_decode, bpe_encode
from glimmer.llm.decontaminate import drop_leaks, find_leaks, item_parts
from glimmer.llm.hmm import Shape, score_texts
from glimmer.llm.lines import dedup_lines
from glimmer.llm.pii import pseudonymise
from glimmer.llm.quality import quality_cascade
from glimmer.llm.simhash import near_duplicates
from glimmer.llm.suffixes import cut_repeats
from glimmer.llm.toxicity import drop_toxic, score_toxicity
from glimmer.llm.warc import read_warc, write_warc

LONG = "many words of one very long text that goes on and on " * 40_000
ROWS = [(1, "the same line of text\nanother line of text here", "x"), (1, "the same line of text\nanother line of text here", "x"), (2, "the same line of text\nanother line of text here", None), (3, None, None), (4, "", "y"), (None, "the same line of text", "z"), (None, None, None), (5, " \t\n\x0b", "w"), (6, LONG, "v"), (7, "日本語のテキスト 😀 é́", "u")]
SCHEMA = "doc_id long, text string, hash string"
CLASH = {"doc": 1, "fp": 2, "block": 3, "n_lines": 4, "score": 5, "lost": 6, "n_email": 7, "bucket": 8, "kept": 9, "label": 10, "n": 11, "c0": 12, "rep": 13}
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({k: F.lit(v) for k, v in CLASH.items()}).repartition(3)


def encoded(docs):
    return bpe_decode(bpe_encode(docs, PATH, public_tokenizers.PATTERN), PATH)


def small_benchmark(spark):
    return spark.createDataFrame([("a", "another line of text"), ("b", None), ("c", ""), (None, "goes on and on")], "item_id string, text string")


def some_labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (3, None), (6, 0), (99, 1)], "doc_id long, toxic int")


def archived(docs, folder=None):
    spark = docs.sparkSession
    out = f"file://{folder}/{uuid.uuid4().hex}"
    write_warc(docs.withColumn("url", F.lit(None).cast("string")), out, key="doc_id", html="text")
    return read_warc(spark, out)


def always(column):
    return F.lit(True)


OPERATORS = {
    "simhash": lambda d, t: near_duplicates(d),
    "toxicity": lambda d, t: score_toxicity(d, some_labels(d.sparkSession), always),
    "drop_toxic": lambda d, t: drop_toxic(d, some_labels(d.sparkSession).where("doc_id = 99"), always),
    "hmm": lambda d, t: score_texts(d, lambda c: c % 7 == 2, Shape(states=2, words=20, shared=8, passes=1)),
    "leaks": lambda d, t: find_leaks(d, small_benchmark(d.sparkSession)),
    "suffixes": lambda d, t: cut_repeats(d),
    "quality": lambda d, t: quality_cascade(d, measures=("n_words", "n_repeat_words", "n_dup_lines", "word_chars")),
    "pii": lambda d, t: pseudonymise(d, "k"),
    "lines": lambda d, t: dedup_lines(d, batch_bytes=1 << 20, fan_out=2),
    "bpe": lambda d, t: encoded(d),
    "warc": archived,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_awkward_rows_all_come_back(spark, tmp_path, name):
    found = OPERATORS[name](awkward(spark), tmp_path).collect()
    assert len(found) == len(ROWS)
    key = "page_id" if name == "warc" else "doc_id"
    assert sorted(str(r[key]) for r in found) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(spark, tmp_path, name):
    assert OPERATORS[name](awkward(spark).where("doc_id < 0"), tmp_path).collect() == []


def test_defined_results(spark):
    docs = awkward(spark)
    same = {r.doc_id: r for r in near_duplicates(docs).where("doc_id < 6").collect()}
    assert same[2].component_id == 1 and same[3].component_id == same[4].component_id == same[5].component_id == 3 and same[3].fingerprint == "0" * 16
    texts = {r.doc_id: (r.text, r.n_dropped) for r in dedup_lines(docs).where("doc_id is not null").collect()}
    assert texts[1] == (ROWS[0][1], 0) and texts[2] == ("", 2) and texts[3] == ("", 0)
    lost = {r.doc_id: r for r in cut_repeats(docs, length=12, k=8).where("doc_id is not null").collect()}
    assert lost[2].kept == b"" and lost[1].n_removed == 0 and lost[3].n_bytes == 0
    assert score_toxicity(docs, some_labels(spark), always).where("doc_id = 4").first().score == 0
    hit = {r.doc_id: r for r in find_leaks(docs, small_benchmark(spark)).where("doc_id in (2, 3, 6)").collect()}
    assert hit[2]["items"] == ["a"] and hit[2].n_hit == 4 and ROWS[2][1].encode()[hit[2].spans[0].start : hit[2].spans[0].stop] == b"another line of text"
    assert hit[3].n_words == 0 and hit[6]["items"] == [None]
    assert {r.doc_id for r in drop_leaks(docs, small_benchmark(spark)).collect()} == {3, 4, 5, 7, None}
    assert {r.doc_id: r.text for r in pseudonymise(docs, "k").where("doc_id in (3, 4)").collect()} == {3: None, 4: ""}


def test_parts_of_a_large_benchmark_give_the_same_hits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).unionByName(awkward(spark).select("doc_id", "text"), allowMissingColumns=True)
    tests = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").cast("string").alias("item_id"), "text").unionByName(small_benchmark(spark))
    whole = sorted(map(str, find_leaks(docs, tests).collect()))
    assert len(list(item_parts(tests, 10, 3_000, "item_id", "text"))) > 3
    assert sorted(map(str, find_leaks(docs, tests, most_nodes=3_000).collect())) == whole
    assert sorted(map(str, drop_leaks(docs, tests, most_nodes=3_000).collect())) == sorted(map(str, drop_leaks(docs, tests).collect()))


def test_one_automaton_at_a_time(spark, monkeypatch):
    """Eight parts: of each the files are removed before the next is read and built."""
    from glimmer.llm import decontaminate

    alive, most = set(), []
    write, remove = decontaminate.write_machine, decontaminate.remove_machine

    def written(session, part, size):
        alive.add(folder := write(session, part, size))
        most.append(len(alive))
        return folder

    def removed(folder):
        alive.remove(folder)
        remove(folder)

    monkeypatch.setattr(decontaminate, "write_machine", written)
    monkeypatch.setattr(decontaminate, "remove_machine", removed)
    tests = spark.createDataFrame([(str(i), " ".join(f"w{j}" for j in range(i, i + 40))) for i in range(4)] + [("long", " ".join(f"x{j}" for j in range(200)))], "item_id string, text string")
    docs = spark.createDataFrame([(1, " ".join(f"x{j}" for j in range(90, 130))), (2, "nothing"), (3, " ".join(f"w{j}" for j in range(30, 60)))], "doc_id long, text string")
    found = {r.doc_id: (r.n_hit, r["items"]) for r in find_leaks(docs, tests, most_nodes=450).collect()}
    assert len(most) >= 8 and max(most) == 1 and not alive
    assert found == {1: (40, ["long"]), 2: (0, []), 3: (13, ["0", "1", "2", "3"])}


def test_automaton_equals_a_plain_search():
    """Windows of all lengths, windows within windows, words that texts repeat; pieces and warm-up."""
    import random

    from glimmer.llm.decontaminate import Automaton, built

    rng = random.Random(4)
    items = [(str(i), [b"abcde"[k : k + 1] for k in rng.choices(range(5), k=rng.randrange(0, 9))]) for i in range(60)] + [(None, [b"f"])]
    machine = Automaton(built(items, 4), 4)
    texts = [b" ".join(rng.choices([b"a", b"b", b"c", b"d", b"e", b"f", b"zz"], k=n)) for n in (0, 1, 3, 50, 64, 65, 700)]
    for text, (n, runs, names) in zip(texts, machine.scan(texts), strict=True):
        words, hit, found = text.split(), set(), set()
        for name, own in items:
            size = min(4, len(own))
            wins = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in wins:
                    found.add(name)
                    hit |= set(range(i, i + size))
        assert n == len(words) and {k for a, b in runs for k in range(a, b)} == hit and names == found


def test_hot_copies_stay_whole(spark):
    """A third of all rows are copies of one text, another third near copies."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, text if i % 3 == 0 else f"{text} tail{i}" if i % 3 == 1 else f"own {i} " * 30) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    parts = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert len(parts) == 600 and {parts[i] for i in range(0, 600, 3)} == {0}
    cut = {r.doc_id: r for r in cut_repeats(docs).collect()}
    assert all(cut[i].kept == b"" for i in range(3, 600, 3)) and cut[0].n_removed == 0
    assert all(cut[i].n_removed >= len(text) + 5 for i in range(4, 600, 3)) and cut[1].n_removed == len(text)
    for size in (1 << 30, 20_000):
        kept = {r.doc_id: r.n_dropped for r in dedup_lines(docs, batch_bytes=size).collect()}
        assert sum(kept.values()) == 199


def test_runs_merge_without_an_exchange(spark, monkeypatch):
    """Many batches and levels, frequent lines by broadcast, and the plans of merging: only the batch itself is moved."""
    monkeypatch.setattr(lines, "MOST_FREQUENT", 3)
    rows = [(i, "\n".join(f"line number {(i * j) % 23} of all" for j in range(1, 6)) + "\na line that all of them hold") for i in range(90)] + [(2**63 - 1, "line number 1 of all\nonly in the last one"), (None, "line number 2 of all\nonly in the last one"), (None, "only without a number")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    plans, write = [], lines.LineRuns.write

    def watched(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df)

    monkeypatch.setattr(lines.LineRuns, "write", watched)
    got = {(r.doc_id, r.text): r.n_dropped for r in dedup_lines(docs, batch_bytes=1000).collect()}
    first = {}
    for i, t in rows:
        for line in t.split("\n"):
            first.setdefault(line, i)
    want = {}
    for i, t in rows:
        parts = t.split("\n")
        kept = [x for x in parts if first[x] == i]
        want[i, "\n".join(kept)] = len(parts) - len(kept)
    assert got == want and len(plans) > 16
    assert any("SortMergeJoin" in p for p in plans) and all(p.count("Exchange hashpartitioning") <= 1 for p in plans)
