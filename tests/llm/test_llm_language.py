"""Language identification: code lengths against plain trees, held-out labels, awkward rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from conftest import DATA
from glimmer.llm import language
from glimmer.llm.language import ORDER, Lookup, Model, compiled, identify, learned


class Tree:
    """Counts of the bytes that follow each context."""

    def __init__(self, texts):
        self.after = {}
        for text in texts:
            padded = bytes(ORDER) + text
            for i in range(ORDER, len(padded)):
                for order in range(ORDER + 1):
                    own = self.after.setdefault(padded[i - order : i], {})
                    own[padded[i]] = own.get(padded[i], 0) + 1

    def bits(self, text):
        padded, total = bytes(ORDER) + text, 0.0
        for i in range(ORDER, len(padded)):
            for order in range(ORDER, -1, -1):
                own = self.after.get(padded[i - order : i])
                if own is None:
                    continue
                n, d = sum(own.values()), len(own)
                if padded[i] in own:
                    total -= math.log2(own[padded[i]] / (n + d))
                    break
                total -= math.log2(d / (n + d))
            else:
                total += 8
        return total


def docs(spark, langs=("de", "en", None), n=90, seed=2):
    rng = random.Random(seed)
    words = {"de": ["der", "und", "ist", "über", "straße"], "en": ["the", "and", "is", "over", "street"], None: ["zzz"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 40))), lang, 1, "x") for i in range(n) for lang in [langs[i % len(langs)]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, bits int, lang_pred string").repartition(4)


def test_lengths_equal_plain_trees(spark, monkeypatch):
    monkeypatch.setattr(language, "TOGETHER", 1000)
    frame = docs(spark)
    counts = learned(frame, lambda d: d % 3 != 2, "doc_id", "text", "lang")
    rows = frame.collect()
    trees = {lang: Tree([r.text.encode() for r in rows if r.lang == lang and r.doc_id % 3 != 2]) for lang in ("de", "en")}
    texts = ["", "der the", "\0\0\0\0\0x", "日本語", *[r.text for r in rows], "straße " * 700, "", "the"]
    got = Model(compiled(counts)).lengths([x.encode() for x in texts])
    want = np.array([[trees[lang].bits(x.encode()) for lang in ("de", "en")] for x in texts])
    assert list(counts) == ["de", "en"] and np.allclose(got, want, rtol=1e-9)


def test_sample_is_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(language, "EACH_BYTES", 600)
    frame = docs(spark, n=300)
    counts = learned(frame, lambda d: F.lit(True), "doc_id", "text", "lang")
    sizes = {lang: sum(len(r.text.encode()) for r in frame.collect() if r.lang == lang) for lang in ("de", "en")}
    for lang, (_, times) in counts.items():
        assert 0 < times.sum() <= 1200 < sizes[lang]


def test_held_out_labels(spark):
    from glimmer.llm.queries import op13_language

    found = op13_language(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 20 and sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_awkward_rows(spark):
    rows = [(1, None, "de", 1, "x"), (2, "", "de", 1, "x"), (3, " 12 !? \n", "de", 1, "x"), (None, "der und die", "de", 1, None), (4, "der und", "de", 1, None), (4, "der und", "de", 1, None), (5, "the and " * 200_000, "en", 1, "x"), (6, "the street", "en", 1, "x"), (7, "é", None, 1, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, bits int, lang_pred string").repartition(3)
    found = identify(frame, lambda d: d != 5).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].bits is None for i in (1, 2, 3))
    assert by[4].lang_pred == by[None].lang_pred == "de" and by[5].lang_pred == "en" and by[7].lang_pred in ("de", "en")
    nothing = identify(frame, lambda d: d == 99).collect()
    assert len(nothing) == len(rows) and {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert identify(frame.where("doc_id > 100"), lambda d: d > 0).collect() == []


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    find = Lookup(keys)
    assert (find(keys) == np.arange(len(keys))).all()
    others = rng.integers(0, 1 << 40, 5000, dtype=np.uint64)
    assert ((find(others) >= 0) == np.isin(others, keys)).all() and (Lookup(keys[:0])(keys[:3]) == -1).all()
