"""Near-copies against the similarity of all pairs."""

import random

import pytest

import corpus_pipeline
from glimmer.llm import jaccard
from glimmer.llm.simhash import fingerprint

rng = random.Random(5)


def passage(n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def edited(text, edits):
    words = text.split()
    for i in rng.sample(range(len(words)), edits):
        words[i] = "changed%d" % rng.randrange(10**6)
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    shared, out = passage(30), ["", " ", "one two", "one  TWO", "three"]
    for _ in range(25):
        own = passage(rng.randrange(20, 300))
        out += [own, own.upper(), f"{shared} {passage(40)}", *(edited(own, e) for e in (1, 2, 4, 6) if e < len(own.split()))]
    large = passage(200)
    return {i: x for i, x in enumerate([*out, *(edited(large, rng.randrange(1, 4)) for _ in range(60))])}


def plain_sets(texts):
    found = {}
    for i, text in texts.items():
        words = text.lower().split()
        found[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}
    return found


def least_of(texts):
    """The least member of each text's component, by links that all pairs show."""
    sets, least = plain_sets(texts), {i: i for i in texts}
    for i in texts:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 9 * both >= 4 * (len(sets[i]) + len(sets[j])) or (fingerprint(texts[i].encode()) ^ fingerprint(texts[j].encode())).bit_count() <= 2:
                a, b = sorted((least[i], least[j]))
                least = {k: a if v == b else v for k, v in least.items()}
    return least


@pytest.mark.parametrize("most, stars, short, hot", [(7, 0, 4, 4), (1024, 2, 32, 1 << 17), (9, 1, 2, 30)])
def test_pipeline_keeps_one_of_near_copies(spark, texts, monkeypatch, most, stars, short, hot):
    monkeypatch.setattr(jaccard.similar_texts, "__defaults__", (5, "key", "text", most, 20_000, stars, short, hot))
    rows = [(i, x) for i, x in texts.items()] + [(None, "alone of its kind without a name"), (None, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()]
    wanted = set(least_of(texts).values())
    assert set(got) == wanted | {None} and len(wanted) < len(texts) - 100


def jaccard_components(texts):
    sets, least = plain_sets(texts), {i: i for i in texts}
    for i in texts:
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((least[i], least[j]))
                least = {k: a if v == b else v for k, v in least.items()}
    return least


def joined_components(links, keys):
    least = {k: k for k in keys}
    for r in links:
        a, b = sorted((least[r.a], least[r.b]))
        least = {k: a if v == b else v for k, v in least.items()}
    return least


def test_one_shingle_in_all_texts(spark):
    """A passage that all texts hold, a chain of edits whose ends are not alike, empty and null texts, rows of one key."""
    everywhere = "this very passage stands in each text of all"
    rows = {i: f"{everywhere} {passage(rng.randrange(1, 60))}" for i in range(150)}
    chain = f"{everywhere} {passage(120)}"
    for i in range(150, 190):
        rows[i] = chain = edited(chain, 1)
    rows |= {190: "", 191: None, 192: "a b", 193: "A  B", 194: everywhere}
    frame = spark.createDataFrame([*rows.items(), *list(rows.items())[:20]], "key long, text string").repartition(5)
    for options in ({}, {"stars": 0, "short": 1, "most": 16}, {"stars": 1, "short": 8, "most_hot": 50}):
        found = jaccard.similar_texts(frame, range_bytes=10_000, **options).collect()
        assert joined_components(found, rows) == jaccard_components({k: v or "" for k, v in rows.items()})


def test_what_many_texts_share_is_one_row_a_slice(spark):
    """Of an item that all texts of a slice hold one row is dealt, not one for each text."""
    same = " ".join(f"s{i}" for i in range(30))
    frame = spark.createDataFrame([(i, same if i % 2 else f"{same} x{i}") for i in range(400)], "key long, text string").coalesce(1)
    links = jaccard.similar_texts(frame).collect()
    assert len(set(joined_components(links, range(400)).values())) == 1 and len(links) < 1000
